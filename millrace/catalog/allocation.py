"""Quotas, template expansion, draws, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import draw_sql, key_sql, load, norm_sql, query, words_sql
from millrace.functions.draws import shuffle_key, uniform, weighted_choice
from millrace.operators import allocate, lookups
from millrace.operators.cuts import exact_split, take_quota
from millrace.operators.ordered import numbered
from millrace.session import cut

LANGS = {"en": 40, "fr": 25, "de": 15, "es": 10}
BANDS = {"easy": 30, "medium": 50, "hard": 20}

GRID_SQL = """
  with t as (select count(*) as n from documents),
       l as (select unnest(['en', 'fr', 'de', 'es']) as language, unnest([40, 25, 15, 10]) as lp),
       b as (select unnest(['easy', 'medium', 'hard']) as difficulty, unnest([30, 50, 20]) as bp),
       q as (select language, difficulty, floor(floor(n * lp / 100) * bp / 100)::bigint as quota,
                    n * lp * bp / 10000 as exact from t, l, b)
"""


def target_rows(spark, sf):
    return load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("target"))


@query(GRID_SQL + "select language, difficulty, quota from q")
def quota_grid(spark, sf):
    return allocate.quota_grid(target_rows(spark, sf), LANGS, BANDS)


@query(
    GRID_SQL
    + """, f as (select *, floor(exact) as base, round(sum(exact) over ()) - sum(floor(exact)) over () as missing,
                        row_number() over (order by exact - floor(exact) desc, language, difficulty) as place from q)
         select language, difficulty, (base + case when place <= missing then 1 else 0 end)::bigint as quota from f"""
)
def quota_grid_exact_total(spark, sf):
    return allocate.quota_grid(target_rows(spark, sf), LANGS, BANDS, mode="largest_remainder")


@query(GRID_SQL + "select sum(quota)::bigint as total from q")
def quota_total(spark, sf):
    grid = allocate.quota_grid(target_rows(spark, sf), LANGS, BANDS)
    inner = grid.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("difficulty", "quota"))).alias("m"))
    nested = inner.select(F.create_map("language", "m").alias("quotas"))
    return allocate.total_quota(nested)


@query(GRID_SQL + "select language, difficulty, unnest(range(1, quota + 1)) as unit from q")
def quota_units(spark, sf):
    grid = allocate.quota_grid(target_rows(spark, sf), LANGS, BANDS)
    return allocate.quota_units(grid, ["language", "difficulty"])


QUOTA_SQL = """
  with t as (select count(*) as n from documents),
       q as (select lang, floor(n * pct / 100)::bigint as quota from t, (select unnest(['en', 'fr', 'de', 'es']) as lang, unnest([40, 20, 5, 15]) as pct))
"""


def lang_quotas(spark, sf):
    """Quotas per language from the number of rows; Spanish asks for more than there is."""
    shares = lookups.share_table(spark, {"en": 40, "fr": 20, "de": 5, "es": 15})
    n = target_rows(spark, sf)
    return shares.select(F.col("label").alias("lang"), F.floor(n.scalar() * F.col("pct") / 100).cast("long").alias("quota"))


SAMPLE_SQL = (
    QUOTA_SQL
    + f""", r as (select doc_id, lang, row_number() over (partition by lang order by {key_sql('doc_id')}, doc_id) as rn from documents),
              s as (select r.doc_id, r.lang from r join q using (lang) where rn <= quota)"""
)


@query(SAMPLE_SQL + "select doc_id, lang from s")
def quota_sample(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return take_quota(docs, ["lang"], lang_quotas(spark, sf), "doc_id")


@query(
    SAMPLE_SQL
    + """select q.lang, q.quota, count(s.doc_id) as delivered, q.quota - count(s.doc_id) as shortfall
         from q left join s using (lang) group by q.lang, q.quota"""
)
def quota_shortfall(spark, sf):
    quotas = cut(lang_quotas(spark, sf))
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return allocate.shortfall(take_quota(docs, ["lang"], quotas, "doc_id"), ["lang"], quotas)


@query(
    QUOTA_SQL
    + f""", c as (select lang, count(distinct md5({norm_sql('text')})) as capacity from documents group by lang)
         select q.lang, q.quota, coalesce(capacity, 0) as capacity, coalesce(capacity, 0) >= q.quota as enough from q left join c using (lang)"""
)
def quota_capacity(spark, sf):
    return allocate.capacity(load(spark, sf, "documents"), ["lang"], "text", lang_quotas(spark, sf))


TEMPLATES = {
    "en": {"easy": ["Explain {concept} briefly", "List ways to {task}"], "hard": ["Compare {features} with {algorithm}"]},
    "fr": {"medium": ["Résoudre {problem}", "Décrire {concept}", "Montrer {algorithm}"]},
}
FALLBACK = ["Note in {language}: {task}", "Outline of {concept} in {language}"]
CATEGORIES = {"easy": ["sorting", "naming"], "medium": ["sorting", "storage", "missing"]}
OTHER = ["storage", "sorting"]
TASKS = {"sorting": ["sort the rows", "merge two lists"], "naming": ["name the columns"], "storage": ["store a table", "parse {problem} and {concept}", "pack"]}


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _pick_sql(options: str, salt: str) -> str:
    return f"{options}[({draw_sql('doc_id', salt)} % len({options}) + 1)::int]"


def _expansion_sql() -> str:
    templates = "case " + " ".join(
        f"when lang = '{a}' and difficulty = '{b}' then {_sql_list(t)}" for a, levels in TEMPLATES.items() for b, t in levels.items()
    ) + " else [" + ", ".join(f"replace('{t}', '{{language}}', lang)" for t in FALLBACK) + "] end"
    cats = "case " + " ".join(f"when difficulty = '{b}' then {_sql_list(c)}" for b, c in CATEGORIES.items()) + f" else {_sql_list(OTHER)} end"
    tasks = "case " + " ".join(f"when category = '{c}' then {_sql_list(t)}" for c, t in TASKS.items()) + " else ['find an answer'] end"
    fill, values = "template", {
        "task": "task", "problem": "task",
        "concept": f"coalesce({words_sql('task')}[-1], 'solution')",
        "algorithm": f"coalesce({words_sql('task')}[1], 'algorithm')",
        "features": "'advanced ' || task",
    }
    for i, slot in enumerate(values, 1):  # marks first, so that braces in a value stay
        fill = f"replace({fill}, '{{{slot}}}', chr({i}))"
    for i, value in enumerate(values.values(), 1):
        fill = f"replace({fill}, chr({i}), {value})"
    return f"""
      with d as (select doc_id, lang, case when n_chars < 500 then 'easy' when n_chars < 2000 then 'medium' else 'hard' end as difficulty from documents),
           o as (select *, {templates} as ts, {cats} as cs from d),
           p as (select *, {_pick_sql('ts', 'template')} as template, {_pick_sql('cs', 'category')} as category from o),
           u as (select *, {tasks} as ks from p),
           k as (select *, {_pick_sql('ks', 'task')} as task from u)
      select doc_id, lang as language, difficulty, category, task, {fill} as instruction from k"""


def expanded(spark, sf):
    size = F.col("n_chars")
    band = F.when(size < 500, "easy").when(size < 2000, "medium").otherwise("hard")
    rows = load(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), band.alias("difficulty"))
    rows = lookups.with_template(rows, lookups.template_table(spark, TEMPLATES), FALLBACK, "doc_id", 42)
    rows = lookups.with_task(rows, CATEGORIES, OTHER, lookups.task_table(spark, TASKS), "find an answer", "doc_id", 42)
    return rows.withColumn("instruction", lookups.filled(F.col("template"), F.col("task")))


@query(_expansion_sql())
def template_texts(spark, sf):
    return expanded(spark, sf).select("doc_id", "language", "difficulty", "category", "task", "instruction")


@query(
    f"""with d as (select doc_id, {draw_sql('doc_id', 'style')} / 4294967296.0::double as u from documents)
        select doc_id, case when u < 0.5 then 'clean' when u < 0.8 then 'documented' else 'optimized' end as style from d"""
)
def style_draws(spark, sf):
    style = weighted_choice(allocate.STYLE_SHARES, 42, F.col("doc_id"), "style")
    return load(spark, sf, "documents").select("doc_id", style.alias("style"))


@query(f"select doc_id from documents where {draw_sql('doc_id', 'review')} / 4294967296.0::double < 0.05")
def review_sample(spark, sf):
    return load(spark, sf, "documents").where(uniform(42, F.col("doc_id"), "review") < 0.05).select("doc_id")


@query(f"select doc_id, lang from documents order by {key_sql('doc_id')}, doc_id limit 100")
def fixed_size_sample(spark, sf):
    """The 100 rows that come first in the seeded shuffle."""
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return docs.orderBy(shuffle_key(42, F.col("doc_id")), "doc_id").limit(100)


@query(f"select doc_id, {key_sql('doc_id')} as shuffle_key, row_number() over (order by {key_sql('doc_id')}, doc_id) as place from documents")
def seeded_order(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", shuffle_key(42, F.col("doc_id")).alias("shuffle_key"))
    return numbered(docs, [], [F.col("shuffle_key"), F.col("doc_id")], "place").orderBy("place")


SPLIT_SQL = f"""
  with t as (select floor(count(*) * 0.8)::bigint as n1, floor(count(*) * 0.1)::bigint as n2 from documents),
       s as (select doc_id, row_number() over (order by {key_sql('doc_id')}, doc_id) as rn from documents),
       x as (select doc_id, case when rn <= n1 then 'train' when rn <= n1 + n2 then 'validation' else 'test' end as split from s, t)
"""


def split_ids(spark, sf):
    return exact_split(load(spark, sf, "documents").select("doc_id"), "doc_id")


@query(SPLIT_SQL + "select doc_id, split from x")
def exact_split_rows(spark, sf):
    return split_ids(spark, sf)


@query(SPLIT_SQL + "select split, count(*) as n from x group by split")
def exact_split_sizes(spark, sf):
    return split_ids(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(SPLIT_SQL + "select doc_id, split from x")
def split_union(spark, sf):
    """The parts taken apart and put together again under their names."""
    rows = cut(split_ids(spark, sf))
    parts = [rows.where(F.col("split") == s).select("doc_id", F.lit(s).alias("split")) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select 0::bigint as shared, 0::bigint as missing, count(*) as n from documents")
def split_disjoint(spark, sf):
    """No id in two parts, none lost: one count per id, then one row of checks."""
    whole = load(spark, sf, "documents").select("doc_id")
    rows = split_ids(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    both = whole.join(rows, "doc_id", "left")
    return both.agg(
        F.count_if(F.col("parts") > 1).alias("shared"),
        F.count_if(F.col("parts").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("n"),
    )
