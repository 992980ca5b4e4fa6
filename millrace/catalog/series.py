"""Ordered series over events, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import load, norm_sql, query, r6, words_sql
from millrace.functions.arrays import mean_squared_gap
from millrace.operators import layout, overlap, rates, rolling

ORDER = ["ts", "event_id"]


def series(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query(
    """select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) as avg_value from events"""
)
def recent_means(spark, sf):
    rows = rolling.recent_mean(series(spark, sf), ["user_id"], [F.col(c) for c in ORDER], ["value"])
    return rows.select("event_id", r6(F.col("avg_value")).alias("avg_value"))


@query(
    """select event_id, round(avg(value) over (order by ts, event_id rows between 9 preceding and current row), 6) as avg_value from events"""
)
def recent_means_one_series(spark, sf):
    """One series without a key."""
    rows = rolling.recent_mean(series(spark, sf), [], [F.col(c) for c in ORDER], ["value"])
    return rows.select("event_id", r6(F.col("avg_value")).alias("avg_value"))


@query(
    """with w as (select event_id, value, avg(value) over w as m, stddev_pop(value) over w as s, count(*) over w as n from events
                  window w as (partition by user_id order by ts, event_id rows between 99 preceding and current row)),
            t as (select event_id, value, case when n > 10 then m + 2 * s end as threshold from w)
       select event_id, round(threshold, 6) as threshold, coalesce(value > threshold, false) as is_clipped,
              round(case when value > threshold then threshold else value end, 6) as clipped from t"""
)
def adaptive_clips(spark, sf):
    rows = rolling.adaptive_clip(series(spark, sf), ["user_id"], [F.col(c) for c in ORDER], "value")
    return rows.select("event_id", r6(F.col("threshold")).alias("threshold"), "is_clipped", r6(F.col("clipped")).alias("clipped"))


def audit_sql(key: str, seconds: int, requests: int, tokens: int) -> str:
    part = f"partition by {key}" if key else ""
    span = seconds * 1_000_000
    return f"""
      with e as (select event_id, epoch_us(ts) as t, floor(value)::bigint as tok, {key or '1'} as key from events),
           w as (select event_id, t, tok, count(*) over w as n, coalesce(sum(tok) over w, 0)::bigint as s, min(t) over w as oldest from e
                 window w as ({part.replace(key, 'key') if key else ''} order by t range between {span - 1} preceding and 1 preceding)),
           f as (select *, n >= {requests} as rpm_hit, s + tok > {tokens} as tpm_hit from w)
      select event_id, n::bigint as in_window, s as tokens_in_window, rpm_hit, tpm_hit,
             round(case when rpm_hit or tpm_hit then ({span} - (t - oldest)) / 1e6 end, 6) as wait_s, tpm_hit and n = 0 as no_history from f"""


def _audit(events, keys, seconds, requests, tokens):
    rows = rates.rate_audit(events, keys, "ts", "event_id", F.floor("value"), seconds, requests, tokens)
    return rows.select("event_id", "in_window", "tokens_in_window", "rpm_hit", "tpm_hit", r6(F.col("wait_s")).alias("wait_s"), "no_history")


@query(audit_sql("user_id", 86_400, 3, 100))
def rate_audit(spark, sf):
    """A day-long window, so that users do reach their limits."""
    return _audit(series(spark, sf), ["user_id"], 86_400, 3, 100)


@query(audit_sql("", 3_600, 15, 400))
def rate_audit_one_limiter(spark, sf):
    """One limiter for all events."""
    return _audit(series(spark, sf), [], 3_600, 15, 400)


@query("select event_id, greatest(least(value, 50.0), -50.0)::double as clipped from events")
def value_clips(spark, sf):
    return series(spark, sf).select("event_id", rolling.clip_magnitude(F.col("value"), 50).alias("clipped"))


@query("select user_id, round(sqrt(sum(value * value)), 6) as norm from events group by 1")
def group_norms(spark, sf):
    return rolling.group_norm(series(spark, sf), ["user_id"], F.col("value")).withColumn("norm", r6(F.col("norm")))


@query(
    """with n as (select user_id, sqrt(sum(value * value)) as norm from events group by 1)
       select event_id, round(value * least(1.0::double, 300.0::double / norm), 6) as scaled from events join n using (user_id)"""
)
def scaled_to_norm(spark, sf):
    rows = rolling.scale_to_norm(series(spark, sf), ["user_id"], "value", "event_id", 300)
    return rows.select("event_id", r6(F.col("scaled")).alias("scaled"))


@query(
    """with v as (select label, vec_id, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings),
            s as (select label, sqrt(list_sum([(x[1]::double - x[2]::double) ** 2 for x in list_zip(a, b)])) as step from v where b is not null)
       select label, round(avg(step), 6) as mean_step, count(*) as steps from s group by label"""
)
def step_sizes(spark, sf):
    rows = rolling.step_sizes(load(spark, sf, "embeddings"), ["label"], "vec_id", "embedding")
    return rows.withColumn("mean_step", r6(F.col("mean_step")))


@query(
    """select label, round(sqrt(sum(list_sum([x::double * x::double for x in embedding]))), 6) as norm from embeddings group by label"""
)
def vector_norms(spark, sf):
    return rolling.vector_norms(load(spark, sf, "embeddings"), ["label"], "embedding").withColumn("norm", r6(F.col("norm")))


@query(
    """select a.label, round(avg(list_sum([(x[1]::double - x[2]::double) ** 2 for x in list_zip(a.embedding[1:48], b.embedding[1:48])]) / 48), 6) as gap, count(*) as pairs
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by a.label"""
)
def paired_vector_gaps(spark, sf):
    """Each vector against the one with the next id; the first is cut to 48 places, and so
    is the comparison."""
    vectors = load(spark, sf, "embeddings")
    one = vectors.select(F.col("vec_id").alias("pair"), "label", F.slice("embedding", 1, 48).alias("a"))
    other = vectors.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b"))
    gaps = one.join(other, "pair").select("label", mean_squared_gap(F.col("a"), F.col("b")).alias("gap"))
    return gaps.groupBy("label").agg(r6(F.avg("gap")).alias("gap"), F.count(F.lit(1)).alias("pairs"))


PAIRS_SQL = """
  with l as (select *, lead(role) over w as next_role, lead(text) over w as output from conversations window w as (partition by conv_id order by turn)),
       p as (select conv_id, turn, text as instruction, output from l where role = 'user' and next_role = 'assistant')
"""


@query(
    PAIRS_SQL
    + """select conv_id, turn, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || output as text from p"""
)
def turn_pairs(spark, sf):
    pairs = layout.turn_pairs(load(spark, sf, "conversations"))
    return pairs.select("conv_id", "turn", layout.pair_text(F.col("instruction"), F.col("output")).alias("text"))


@query(
    PAIRS_SQL
    + f""", t as (select conv_id, turn, {words_sql("'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || output")} as w,
                         len({words_sql("'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10)")}) as h from p),
              f as (select conv_id, turn, h, len(w) as n, w[1:32] || list_transform(range(greatest(32 - len(w), 0)), lambda i: '<pad>') as tokens from t)
       select conv_id, turn, array_to_string(tokens, ' ') as tokens,
              array_to_string(list_transform(range(32), lambda i: case when i < n then 1 else 0 end), ',') as mask,
              array_to_string(list_transform(range(32), lambda i: case when i < h then -100 else length(tokens[i + 1]) end), ',') as labels from f"""
)
def fixed_width_rows(spark, sf):
    pairs = layout.turn_pairs(load(spark, sf, "conversations"))
    rows = layout.fixed_rows(pairs, 32)
    return rows.select(
        "conv_id",
        "turn",
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"),
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
    )


WORDS_SQL = PAIRS_SQL + f""", w as (select conv_id, turn, {words_sql(norm_sql('output'))} as a, {words_sql(norm_sql('instruction'))} as b from p)"""
GRAMS_SQL = WORDS_SQL.replace("with l as", "with recursive l as") + """,
  g as (select conv_id, turn, n, true as own, array_to_string(a[i : i + n - 1], ' ') as g from (select *, unnest(range(1, len(a) - n + 2)) as i from (select *, unnest([1, 2, 3, 4]) as n from w))
        union all
        select conv_id, turn, n, false, array_to_string(b[i : i + n - 1], ' ') from (select *, unnest(range(1, len(b) - n + 2)) as i from (select *, unnest([1, 2, 3, 4]) as n from w))),
  k as (select conv_id, turn, n, g, count(*) filter (where own) as c, count(*) filter (where not own) as r from g group by all),
  m as (select conv_id, turn, n, sum(least(c, r)) as m, sum(c) as c, sum(r) as r from k group by all),
  x as (select conv_id, turn, {columns} from w left join m using (conv_id, turn) group by conv_id, turn)
""".format(columns=", ".join(f"coalesce(max({v}) filter (where n = {i}), 0)::double as {v}{i}" for v in "mcr" for i in (1, 2, 3, 4)))


@query(
    GRAMS_SQL
    + """select conv_id, turn, round(case when m1 * m2 * m3 * m4 > 0 then (case when c1 > r1 then 1 else exp(1 - r1 / c1) end)
         * exp((ln(m1 / c1) + ln(m2 / c2) + ln(m3 / c3) + ln(m4 / c4)) / 4) else 0 end, 6) as bleu from x"""
)
def bleu_scores(spark, sf):
    """How much of its instruction each answer repeats."""
    pairs = layout.turn_pairs(load(spark, sf, "conversations"))
    rows = overlap.bleu(pairs, ["conv_id", "turn"], "output", "instruction")
    return rows.withColumn("bleu", r6(F.col("bleu")))


@query(
    GRAMS_SQL
    + """, lcs as (
           select conv_id, turn, a, b, 0 as i, list_transform(b, lambda z: 0) as dp from w
           union all
           select conv_id, turn, a, b, i + 1, list_transform(range(1, len(up) + 1), lambda j: list_max(up[1 : j])) from (
             select *, list_transform(range(1, len(b) + 1), lambda j: case when b[j] = a[i + 1] then coalesce(case when j > 1 then dp[j - 1] end, 0) + 1 else dp[j] end) as up
             from lcs where i < len(a))),
         e as (select conv_id, turn, coalesce(list_max(dp), 0) as lcs, len(a) + len(b) as n from lcs where i = len(a))
       select conv_id, turn, round(case when m1 > 0 then 2 * m1 / (c1 + r1) else 0 end, 6) as rouge_1, round(case when m2 > 0 then 2 * m2 / (c2 + r2) else 0 end, 6) as rouge_2,
              round(case when lcs > 0 then 2 * lcs / n else 0 end, 6) as rouge_l from x join e using (conv_id, turn)"""
)
def rouge_scores(spark, sf):
    pairs = layout.turn_pairs(load(spark, sf, "conversations"))
    grams = overlap.rouge(pairs, ["conv_id", "turn"], "output", "instruction")
    longest = pairs.select("conv_id", "turn", overlap.rouge_l(F.col("output"), F.col("instruction")).alias("rouge_l"))
    rows = grams.join(longest, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", *[r6(F.col(c)).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")])


@query(
    f"""with l as (select doc_id, lang, string_split(text, chr(10)) as ls from documents),
             p as (select doc_id, lang, ls[len(ls)] as c, unnest(range(1, len(ls))) as side, unnest(ls[1 : len(ls) - 1]) as r from l where len(ls) > 1),
             s as (select doc_id, lang, side, {words_sql(norm_sql('r'))} as w from p
                   union all select doc_id, lang, 0, {words_sql(norm_sql('c'))} from (select distinct doc_id, lang, c from p)),
             g as (select doc_id, lang, side, n, array_to_string(w[i : i + n - 1], ' ') as g
                   from (select *, unnest(range(1, len(w) - n + 2)) as i from (select *, unnest([1, 2, 3, 4]) as n from s))),
             k as (select doc_id, lang, n, g, side, count(*) as c from g group by all),
             m as (select doc_id, lang, n, g, max(c) filter (where side = 0) as c, coalesce(max(c) filter (where side > 0), 0) as r from k group by all),
             t as (select lang, n, sum(least(c, r))::double as m, sum(c)::double as c from m where c is not null group by all),
             o as (select doc_id, len(w) as c from s where side = 0),
             e as (select doc_id, lang, any_value(o.c) as c, min(abs(len(w) - o.c) * 1000000 + len(w)) % 1000000 as r from s join o using (doc_id) where side > 0 group by all),
             z as (select lang, sum(c)::bigint as candidates, sum(r)::bigint as "references" from e group by all),
             x as (select lang, count(*) filter (where m > 0) as hits, avg(ln(m / c)) filter (where m > 0) as mean from t where n between 1 and 4 group by all)
        select lang, candidates, "references", round(case when hits = 4 then (case when candidates > "references" then 1 else exp(1 - "references" / candidates) end) * exp(mean) else 0 end, 6) as bleu
        from z left join x using (lang)"""
)
def corpus_bleu_by_lang(spark, sf):
    """How much the last lines of a language's documents repeat of the lines before them."""
    lines = F.split("text", "\n", -1)
    pairs = load(spark, sf, "documents").select("doc_id", "lang", lines.alias("ls")).where(F.size("ls") > 1)
    pairs = pairs.select("doc_id", "lang", F.element_at("ls", -1).alias("c"), F.slice("ls", F.lit(1), F.size("ls") - 1).alias("rs"))
    rows = overlap.corpus_bleu(pairs, ["doc_id"], ["lang"], "c", "rs")
    return rows.withColumn("bleu", r6(F.col("bleu")))
