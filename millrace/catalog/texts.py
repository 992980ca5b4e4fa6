"""Text, number and time columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import SPACE_SQL, load, norm_sql, query, r6, strip_sql, words_sql
from millrace.functions import privacy
from millrace.functions import text as tx
from millrace.functions.code import compiles, parse_state, syntax_facts
from millrace.operators import spans
from millrace.operators.code_metrics import code_quality
from millrace.operators.ledger import option_or, token_cost
from millrace.operators.rolling import age_weights as age_decay
from millrace.operators.rolling import elapsed


@query(f"select doc_id, md5({norm_sql('text')}) as text_key from documents")
def text_keys(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.text_key(F.col("text")).alias("text_key"))


@query(
    f"""select doc_id, cast(length(text) as bigint) as n_raw, cast(length({strip_sql('text')}) as bigint) as n_stripped,
               cast(length(text) // 4 as bigint) as n_tokens from documents"""
)
def text_sizes(spark, sf):
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        F.length(text).cast("long").alias("n_raw"),
        tx.stripped_length(text).cast("long").alias("n_stripped"),
        tx.token_estimate(text).cast("long").alias("n_tokens"),
    )


@query(
    f"""select doc_id, coalesce(w[1], 'algorithm') as first_word, coalesce(w[-1], 'solution') as last_word
        from (select doc_id, {words_sql('text')} as w from documents)"""
)
def edge_words(spark, sf):
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        tx.first_word(text, "algorithm").alias("first_word"),
        tx.last_word(text, "solution").alias("last_word"),
    )


@query(
    f"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
             c as (select doc_id, cast(len(ls) as bigint) as line_count,
                   cast(len(list_filter(ls, lambda x: starts_with(trim(x, {SPACE_SQL}), '#'))) as bigint) as comment_lines from l)
        select *, round(comment_lines / greatest(line_count, 1), 6) as comment_density from c"""
)
def line_facts(spark, sf):
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        tx.line_count(text).cast("long").alias("line_count"),
        tx.comment_lines(text).cast("long").alias("comment_lines"),
        r6(tx.comment_density(text)).alias("comment_density"),
    )


@query(
    """select p_partkey, replace(replace(replace(p_brand || ' (' || p_type || ')', ' ', '_'), '(', ''), ')', '') as file_key
       from part"""
)
def file_keys(spark, sf):
    name = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return load(spark, sf, "part").select("p_partkey", tx.file_key(name).alias("file_key"))


@query(
    """select p_partkey, 'f(' || p_partkey || ')' as input, p_size || '' as expected from part where p_partkey % 3 = 0"""
)
def assertion_parts(spark, sf):
    """Lines made from the parts: one form parses, one lacks a comparison, one has two."""
    call = F.concat(F.lit("assert f("), F.col("p_partkey").cast("string"), F.lit(")"))
    size = F.col("p_size").cast("string")
    form = F.col("p_partkey") % 3
    line = F.when(form == 0, F.concat(call, F.lit(" == "), size)).when(form == 1, call).otherwise(
        F.concat(call, F.lit(" == "), size, F.lit(" == "), size)
    )
    parsed = load(spark, sf, "part").select("p_partkey", tx.assertion_parts(line).alias("p"))
    return parsed.where("p is not null").select("p_partkey", "p.input", "p.expected")


@query(
    """select p_partkey, unnest([0, 3])::int as place, 'g(' || unnest([p_size, p_partkey]) || ')' as input, unnest([p_partkey, p_size]) || '' as expected from part"""
)
def test_case_rows(spark, sf):
    """A list of test lines per part, one row per line that parses."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")

    def line(call, *expected):
        return F.concat(F.lit("assert g("), call, F.lit(")"), *[x for e in expected for x in (F.lit(" == "), e)])

    lines = F.array(line(size, key), line(size), line(size, key, key), line(key, size))
    listed = load(spark, sf, "part").select("p_partkey", F.posexplode(lines).alias("place", "line"))
    parsed = listed.select("p_partkey", "place", tx.assertion_parts(F.col("line")).alias("p"))
    return parsed.where("p is not null").select("p_partkey", "place", "p.input", "p.expected")


def _mask_sql(c: str) -> str:
    for pattern, mark in privacy.MASKS.items():
        c = f"regexp_replace({c}, '{pattern}', '{mark}', 'g')"
    return c


@query(f"select doc_id, {_mask_sql('text')} as masked, {_mask_sql('text')} <> text as changed from documents")
def masked_texts(spark, sf):
    masked = load(spark, sf, "documents").select("doc_id", "text", privacy.mask(F.col("text")).alias("masked"))
    return masked.select("doc_id", "masked", (F.col("masked") != F.col("text")).alias("changed"))


@query("select event_id, substr(sha256('pepper:' || user_id), 1, 16) as who from events")
def event_pseudonyms(spark, sf):
    return load(spark, sf, "events").select("event_id", privacy.pseudonym(F.col("user_id"), "pepper").alias("who"))


ANY_MASK = "|".join(f"(?:{pattern})" for pattern in privacy.MASKS)
DOUBLED = "case when k % 2 = 0 then substr(d, k, 1)::int * 2 - case when substr(d, k, 1)::int > 4 then 9 else 0 end else substr(d, k, 1)::int end"
KIND = " ".join(f"when regexp_full_match(hit, '{pattern}') then " + (f"case when card then '{mark}' end" if mark == privacy.CHECKED else f"'{mark}'") for pattern, mark in privacy.MASKS.items())
HITS_SQL = f"""
    with p as (select doc_id, string_split_regex(text, '{ANY_MASK}') as g, regexp_extract_all(text, '{ANY_MASK}') as h from documents where text is not null),
         e as (select doc_id, unnest(range(1, len(g) + 1)) as i, g, h from p),
         s as (select doc_id, i, g[i] as gap, h[i] as hit, length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i - 1], '')) as pos,
                      reverse(regexp_replace(coalesce(h[i], ''), '[^0-9]', '', 'g')) as d from e),
         c as (select *, coalesce(list_sum(list_transform(range(1, length(d) + 1), lambda k: {DOUBLED})) % 10 = 0, false) as card from s),
         m as (select *, case {KIND} end as mark from c)"""


@query(HITS_SQL + " select doc_id, mark, pos::bigint as start, length(hit) as length from m where mark is not null")
def personal_spans(spark, sf):
    return spans.personal_spans(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query(HITS_SQL + " select doc_id, string_agg(gap || coalesce(mark, hit, ''), '' order by i) as masked from m group by 1")
def masked_texts_checked(spark, sf):
    """Masks as `masked_texts` puts them, but card numbers only with a right check digit."""
    docs = load(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", privacy.mask_checked(F.col("text")).alias("masked"))


CARDS = "lpad((1000 + l_orderkey % 9000)::varchar, 4, '0') || ' ' || lpad((l_partkey % 10000)::varchar, 4, '0') || ' ' || lpad((l_suppkey % 10000)::varchar, 4, '0') || ' ' || lpad((l_linenumber * 7 + l_orderkey % 10)::varchar, 4, '0')"


@query(
    f"""with c as (select {CARDS} as card from lineitem), n as (select card, reverse(replace(card, ' ', '')) as d from c)
        select count(*) as cards, count(*) filter (list_sum(list_transform(range(1, 17), lambda k: {DOUBLED})) % 10 = 0) as valid from n"""
)
def card_checks(spark, sf):
    """Sixteen digits made of each line item's keys, and how many of them have a right check digit."""
    four = lambda e: F.lpad(F.expr(e).cast("string"), 4, "0")
    card = F.concat_ws(" ", four("1000 + l_orderkey % 9000"), four("l_partkey % 10000"), four("l_suppkey % 10000"), four("l_linenumber * 7 + l_orderkey % 10"))
    rows = load(spark, sf, "lineitem").select(privacy.check_digit_ok(card).alias("ok"))
    return rows.agg(F.count(F.lit(1)).alias("cards"), F.count_if("ok").alias("valid"))


@query(
    """with k as (select text as k from benchmark order by item_id limit 1),
            b as (select rpad(case when octet_length(encode(k)) > 64 then sha256(k) else hex(encode(k)) end, 128, '0') as b from k),
            p as (select unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(('0x' || substr(b, 2 * i::int + 1, 2))::int, 54))), '')) as i,
                         unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(('0x' || substr(b, 2 * i::int + 1, 2))::int, 92))), '')) as o from b)
       select event_id, substr(sha256(p.o || unhex(sha256(p.i || encode(user_id::varchar)))), 1, 32) as who from events, p"""
)
def event_keyed_names(spark, sf):
    """Names that only the holder of a key can make again; the key is read from a table (here the first benchmark text)."""
    keys = load(spark, sf, "benchmark").orderBy("item_id").limit(1)
    return load(spark, sf, "events").select("event_id", privacy.keyed_digest(F.col("user_id"), privacy.key_pads(keys, "text"), 32).alias("who"))


@query(
    f"""select doc_id, {strip_sql("substr(text, length(lang || source) + 1)")} as rest from documents"""
)
def prefix_dropped(spark, sf):
    rest = tx.drop_prefix(F.col("text"), F.concat("lang", "source"))
    return load(spark, sf, "documents").select("doc_id", rest.alias("rest"))


@query(
    """select doc_id, 'Record ' || doc_id || chr(10) || '- Language: ' || lang
         || case when doc_id % 4 > 0 then chr(10) || chr(10) || 'Context: ' || source else '' end
         || case doc_id % 3 when 1 then chr(10) || '- with notes' when 2 then chr(10) || '- short' else '' end
         || chr(10) || chr(10) || 'End of ' || lang as record from documents"""
)
def record_texts(spark, sf):
    style = F.element_at(F.array(F.lit("clean"), F.lit("documented"), F.lit("optimized")), (F.col("doc_id") % 3 + 1).cast("int"))
    context = F.when(F.col("doc_id") % 4 > 0, F.col("source")).otherwise(F.lit(""))
    record = tx.render_record(
        [F.concat(F.lit("Record "), F.col("doc_id").cast("string")), F.concat(F.lit("- Language: "), F.col("lang"))],
        context,
        style,
        {"documented": "- with notes", "optimized": "- short"},
        F.concat(F.lit("End of "), F.col("lang")),
    )
    return load(spark, sf, "documents").select("doc_id", record.alias("record"))


@query("select upper(source) as heading, count(*) as n from documents group by 1")
def headings(spark, sf):
    return load(spark, sf, "documents").groupBy(F.upper("source").alias("heading")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select p_partkey, case when contains(lower(p_type), 'econ') or contains(lower(p_type), 'small') then 'basic'
                              when contains(lower(p_type), 'promo') then 'offer'
                              when contains(lower(p_type), 'large') then 'bulk' else 'plain' end as class from part"""
)
def name_classes(spark, sf):
    rules = [(("econ", "small"), "basic"), (("PROMO",), "offer"), (("large",), "bulk")]
    return load(spark, sf, "part").select("p_partkey", tx.first_match(F.col("p_type"), rules, "plain").alias("class"))


@query(
    """select event_id, round(cast(json_extract(props, '$.k') as bigint) * 15 / 1000000
              + floor(value) * 75 / 1000000, 9) as cost from events"""
)
def usage_costs(spark, sf):
    k = F.from_json("props", "k long")["k"]
    cost = token_cost(k, F.floor("value"))
    return load(spark, sf, "events").select("event_id", F.round(cost, 9).alias("cost"))


@query(
    """select event_id, cast(json_extract(props, '$.k') as bigint) as k,
              '{"k":' || cast(json_extract(props, '$.k') as bigint) || '}' as props_again from events"""
)
def json_props(spark, sf):
    parsed = load(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "p.k", F.to_json("p").alias("props_again"))


@query(
    """select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events"""
)
def time_texts(spark, sf):
    return load(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


@query(
    """with o as (select event_id, case when k >= 50 then k end as given from
                  (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events))
       select event_id, coalesce(given, 4096) as max_tokens from o"""
)
def option_defaults(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return load(spark, sf, "events").select("event_id", option_or(F.when(k >= 50, k), 4096).cast("long").alias("max_tokens"))


@query(
    """select event_id, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6, 6)
              as elapsed_s from events"""
)
def elapsed_times(spark, sf):
    rows = elapsed(load(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id")
    return rows.select("event_id", r6(F.col("elapsed_s")).alias("elapsed_s"))


@query(
    """with e as (select event_id, nullif(event_type, 'error') as kind, epoch_us(ts) / 1e6 as s from events),
            r as (select *, pow(0.5, (max(s) over (partition by kind) - s) / 604800) as raw from e)
       select event_id, round(raw / sum(raw) over (partition by kind), 9) as weight from r"""
)
def age_weights(spark, sf):
    """Weights that halve with every week of age, per kind of event; errors have no kind."""
    kind = F.nullif(F.col("event_type"), F.lit("error")).alias("kind")
    rows = age_decay(load(spark, sf, "events").select("event_id", kind, "ts"), ["kind"], "ts", 7 * 86_400)
    return rows.select("event_id", F.round("weight", 9).alias("weight"))


def part_code(spark, sf):
    """A small program per part: every seventh lacks its colon, every fifth returns outside
    a function, the others hold one loop and `p_size % 4` branches, and a docstring when
    the size is even."""
    size = F.col("p_size")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    doc = F.when(size % 2 == 0, F.lit('    """doc"""\n')).otherwise(F.lit(""))
    branches = F.repeat(F.lit("    if x > 1:\n        x = x - 1\n"), (size % 4).cast("int"))
    good = F.concat(
        F.lit("def "), name, F.lit("(x):\n"), doc, F.lit("    # "), F.col("p_name"), F.lit("\n    for i in x:\n        pass\n"), branches, F.lit("    return x\n")
    )
    bad = F.concat(F.lit("def "), name, F.lit("(x)\n    return x\n"))
    code = F.when(F.col("p_partkey") % 7 == 0, bad).when(F.col("p_partkey") % 5 == 0, F.lit("return 1\n")).otherwise(good)
    return load(spark, sf, "part").select("p_partkey", "p_size", code.alias("code"))


@query(
    """select p_partkey, p_partkey % 7 <> 0 as parses, p_partkey % 7 <> 0 and p_partkey % 5 <> 0 as compiles,
              p_partkey % 7 = 0 as has_error from part"""
)
def code_validity(spark, sf):
    """Two grammars of strictness: `return` outside a function parses but does not compile."""
    rows = part_code(spark, sf).select("p_partkey", parse_state(F.col("code")).alias("s"), compiles(F.col("code")).alias("compiles"))
    return rows.select("p_partkey", F.col("s.ok").alias("parses"), "compiles", F.startswith("s.error", F.lit("Syntax Error")).alias("e")).select(
        "p_partkey", "parses", "compiles", F.coalesce("e", F.lit(False)).alias("has_error")
    )


@query(
    """with c as (select p_partkey, p_name, p_size, length(p_partkey::varchar) as z, case when p_partkey % 7 = 0 then 'bad' when p_partkey % 5 = 0 then 'flat' else 'good' end as k from part)
       select p_partkey,
         case k when 'good' then 59 + z + length(p_name) + 32 * (p_size % 4) + case p_size % 2 when 0 then 14 else 0 end when 'flat' then 9 else 22 + z end::bigint as length,
         case k when 'good' then 6 + 2 * (p_size % 4) + (p_size % 2 = 0)::int when 'flat' then 2 else 3 end::bigint as lines, k <> 'bad' as parse_ok,
         case k when 'good' then 1 + p_size % 4 when 'flat' then 0 end::double as complexity,
         case k when 'good' then (p_size % 2 = 0)::int when 'flat' then 0 end::double as docstrings,
         case k when 'good' then round(1.0 / (6 + 2 * (p_size % 4) + (p_size % 2 = 0)::int), 6)::double when 'flat' then 0.0::double end as readability
       from c"""
)
def code_facts(spark, sf):
    rows = code_quality(part_code(spark, sf), "code")
    return rows.select(
        "p_partkey", F.col("length").cast("long").alias("length"), F.col("lines").cast("long").alias("lines"), "parse_ok",
        "complexity", F.col("docstrings").cast("double").alias("docstrings"), r6(F.col("readability")).alias("readability")
    )


@query(
    """with g as (select p_size % 4 as k, (p_size % 2 = 0)::int as d from part where p_partkey % 7 <> 0 and p_partkey % 5 <> 0),
            f as (select count(*) as n from part where p_partkey % 7 <> 0 and p_partkey % 5 = 0),
            t as (select count(*) as n, sum(k) as k, sum(d) as d from g),
            c as (select unnest(['Module', 'Return', 'FunctionDef', 'arguments', 'arg', 'For', 'Pass', 'Expr', 'Constant', 'Name', 'Load', 'Store',
                                 'If', 'Compare', 'Gt', 'Assign', 'BinOp', 'Sub']) as node,
                         unnest([t.n + f.n, t.n + f.n, t.n, t.n, t.n, t.n, t.n, d, d + 2 * k + f.n, 3 * t.n + 3 * k, 2 * t.n + 2 * k, t.n + k,
                                 k, k, k, k, k, k])::bigint as n from t, f)
       select node, n from c where n > 0"""
)
def node_totals(spark, sf):
    """How often each kind of syntax node stands in the programs."""
    nodes = part_code(spark, sf).select(F.explode(syntax_facts(F.col("code"))["nodes"]).alias("node", "n"))
    return nodes.groupBy("node").agg(F.sum("n").alias("n"))
