"""The queries of the operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, bpe, counts, extraction, jaccard, lattice, licenses, packing, pieces, quality, spelling, topk, toxicity
from millrace.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality; the labels of fold 1 of 3 are held out of learning."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 3) != 1)
    rows, model = quality.train(quality.described(documents(spark, sf), keep=["doc_id"]), labels)
    scored = quality.scored(rows, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    """
    with q as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scores as (
        select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))) as bigint) as score
        from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
    ), ranked as (
        select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores
    )
    select query_id, rank, vec_id, score from ranked where rank <= 20
    """
)
def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best matches of every vector whose id is divisible by 20, among all others."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), topk.grid(F.col("embedding")).alias("vec"))
    return topk.top_k(rows.where("id % 20 = 0"), rows, 20)


def _license_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
    sets = ", ".join(f"({ws!r}, '{label}', {licenses.needed(len(ws))})" for label, ws in licenses.template_words(licenses.TEMPLATES))
    return f"""
    with phrases(p, label) as (values {phrases}), templates(ws, label, k) as (values {sets}),
    docs as (
        select doc_id, {lower} as t, regexp_extract_all({lower}, '{word}') as w from documents
    ), places as (
        select doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) as pos from docs, phrases
    ), base as (
        select doc_id, count(*) as n, min(pos) as first_word, max(pos) as last_word, list_sort(list_distinct(list(label))) as labels from places group by doc_id
    ), blocks as (
        select doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{word}')) as b from docs
    ), met as (
        select doc_id, list(label) as labels, max(len(list_intersect(ws, b)) / len(ws)) as share from blocks, templates
        where len(list_intersect(ws, b)) >= k group by doc_id
    )
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, first_word, last_word,
        coalesce(array_to_string(base.labels, ','), '') as base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') as labels,
        greatest(case when n > 0 then 1.0::double else 0.0::double end, coalesce(share, 0.0::double)) as score
    from docs left join base using (doc_id) left join met using (doc_id)
    """


@query(_license_sql())
def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's license phrases and the labels of the notices that its lines hold."""
    return licenses.scan(documents(spark, sf))


@query()
def op4_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = extraction.extract_text(pages, extraction.learn(pages), out="text", keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pre-tokens and unigram tokens."""
    return counts.token_counts(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op6_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's links of cosine 0.98 or more within its label, and its component."""
    return lattice.similar_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query(
    r"""
    with recursive words as (
        select doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
        from documents
    ), sets as (
        select doc_id, case when len(w) = 0 then []
            when len(w) < 3 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
        from words
    ), items as (
        select doc_id, len(s) as n, unnest(s) as t from sets
    ), links as (
        select x.doc_id as a, y.doc_id as b from items x join items y on x.t = y.t and x.doc_id <> y.doc_id
        group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
    ), reach as (
        select doc_id as a, doc_id as b from documents
        union
        select reach.a, links.b from reach join links on reach.b = links.a
    )
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.c as component_id
    from sets s join (select a, min(b) as c from reach group by a) r on s.doc_id = r.a
    """
)
def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's group of texts whose 3-word shingle sets are at least 0.9 alike."""
    return jaccard.similar_groups(documents(spark, sf), n=3, num=9, den=10)


@query()
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    return bpe.encoding_digests(documents(spark, sf), vocabulary())


@query()
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document."""
    return packing.pack(documents(spark, sf), vocabulary(), with_ids=False)


@query()
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity; fold 2 of 4 is held out of learning."""
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op11_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of their decoded text."""
    return pieces.encoding_digests(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents, some of them misspelled on purpose, with its near words and its form."""
    return spelling.spelling_variants(documents(spark, sf), change_every=31)


@query()
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's groups of byte-level and SentencePiece tokens, and how usual its links are."""
    return alignment.link_counts(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
