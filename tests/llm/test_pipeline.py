"""The pipeline by stages, and the registered queries on the smallest tables."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import packing
from millrace.llm.catalog import ORACLES, QUERIES, vocabulary
from millrace.session import fresh_folder

FOLDER = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "re") for b in ("ra", "li", "mo", "te", "su") for c in ("n", "s", "")]
BAD = ["vilezz", "grimzz", "foulzz"]


@pytest.fixture(scope="module")
def folder(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        bad, junk = r.random() < 0.12, r.random() < 0.15
        w = [r.choice(WORDS) for _ in range(r.randint(30, 80))]
        if bad:
            w[3:3] = [r.choice(BAD) for _ in range(4)]
        if junk:
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not junk), int(bad)))
    clean = [x for x, (_, q, t) in zip(rows, labels, strict=True) if q and not t]
    for k in range(60):
        i, t, *_ = clean[k]
        w = t.split()
        if k % 3:
            w[k % len(w)] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "s", 1))
    rows += [(5, rows[5][1], "en", "s", 1), (2000, None, None, None, None), (2001, "", "en", None, 0), (None, clean[0][1], "en", "s", 1)]
    out = fresh_folder(spark, "pipeline-test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, {a: (b, c) for a, b, c in labels}


def near_kept(rows):
    """Brute force over rows (id, text): the ids that stay."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in up if find(i) == i}


def test_stages(spark, folder):
    path, truth = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = fresh_folder(spark, name)
        stage(spark, docs, path).write.parquet(out)
        seen[name] = (docs, spark.read.parquet(out))
        docs = seen[name][1]
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: [x.doc_id for x in d.select("doc_id").collect()] for n, (_, d) in seen.items() if n != "packing"}
    toxic, junk = ({i for i, v in truth.items() if v[k] == y} for k, y in ((1, 1), (0, 0)))
    assert len(toxic & set(ids["toxicity"])) <= 0.25 * len(toxic)
    assert len(set(truth) - toxic - set(ids["toxicity"])) <= 0.02 * len(truth)
    assert len(junk & set(ids["quality"])) <= 0.1 * len(junk) and {2000, 2001} <= set(ids["toxicity"])
    before = [(x.doc_id, x.text) for x in seen["near_copies"][0].collect()]
    after = ids["near_copies"]
    assert set(after) - {None} == near_kept(before) and len(after) == len(set(after))
    lib = Tokenizer.from_file(vocabulary())
    kept = {x.doc_id: x.text or "" for x in seen["near_copies"][1].collect() if x.doc_id is not None}
    back = {x.doc_id: x.ids for x in packing.unpack(seen["packing"][1].where("doc_id is not null")).collect()}
    assert back == {i: lib.encode(t, add_special_tokens=False).ids for i, t in kept.items()}


def test_unlike_texts_under_one_id_stay(spark):
    """And repeated rows, null ids and texts, columns of any type and name."""
    p = " ".join(f"word{i}" for i in range(30))
    q, r = p.replace("word", "other"), p.replace("word", "third")
    rows = [(1, p, {"a": 1}), (1, q, {"b": 2}), (2, r, None), (2, r, {"c": 3}), (3, p, None), (4, q + " more", None), (0, r + " end", None),
            (None, p, None), (None, p, None), (7, None, None), (7, None, None), (7, "", None), (-5, "short text", None), (5, "short text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key map<string,int>").withColumn("score", F.lit(1)).withColumn("same", F.lit(2)).repartition(4)
    got = corpus_pipeline.near_copies_stage(spark, docs, "")
    assert got.columns == docs.columns
    found = sorted(((x.doc_id, x.text or "") for x in got.collect()), key=str)
    assert found == sorted([(1, p), (1, q), (0, r + " end"), (None, p), (None, p), (7, ""), (-5, "short text")], key=str)
    assert corpus_pipeline.near_copies_stage(spark, docs.limit(0), "").count() == 0


def test_few_dropped_documents_shuffle_no_texts(spark, monkeypatch):
    p = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, p), (2, p + " end"), (3, "other"), (3, "other"), (3, "third")], "doc_id long, text string")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = corpus_pipeline.near_copies_stage(spark, docs, "")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted((x.doc_id, x.text) for x in got.collect())
    finally:
        spark.conf.set(threshold, before)
    assert found == [(1, p), (3, "other"), (3, "third")]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_run_does_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert corpus_pipeline.ORACLE_SQL is None and got.select("sequence_id").distinct().count() == got.count() > 0


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize(
    "name,table,columns",
    [
        ("op1_quality", "documents", "doc_id held_out predicted score"),
        ("op4_extraction", "pages", "n_chars page_id text url"),
        ("op5_counts", "documents", "doc_id n_pretokens n_tokens"),
        ("op6_lattice", "embeddings", "component_id kept n_links vec_id"),
        ("op8_bpe", "documents", "decoded_sha256 doc_id ids_sha256 n_tokens"),
        ("op9_packing", "documents", "bucket doc_id doc_tokens ids_crc32 length offset sequence_id start"),
        ("op10_toxicity", "documents", "doc_id held_out predicted score"),
        ("op11_pieces", "documents", "decoded_sha256 doc_id ids_sha256 n_tokens"),
        ("op13_alignment", "documents", "count_sum doc_id groups_sha256 n_a n_b n_best n_groups n_links"),
    ],
)
def test_query_covers_its_table(spark, name, table, columns):
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == columns.split()
    key = got.columns[0]
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    assert got.select(key).distinct().exceptAll(want.distinct()).count() == 0 == want.distinct().exceptAll(got.select(key).distinct()).count()
