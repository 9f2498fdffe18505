"""A corpus pipeline over ``documents``: five stages, each by an operator of ``brindle.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``docs`` is that stage's output, read from Parquet.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import line_dedup, mix, ngram_join, quality
from brindle.llm.queries import read, token_digests
from brindle.llm.shared import fresh, prepare, remove, sized, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.5 go.

    Null, empty and blank texts score alike, by features that are all 0.
    Repeated rows and equal texts share their lot; texts of any length are
    looked at whole; every column passes, whatever its name (a column score, too); an empty table stays empty.
    """
    prepare(spark)
    (out,) = fresh(docs, "score")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, *docs.columns, out=out).where(F.col(out) >= 0.5).drop(out)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; n_chars follows the text; documents that consisted of such lines alone go.

    Null and empty texts have no such line and stay.  A null source is one
    site, a null doc_id comes last.  Rows that repeat are treated alike.  Texts
    of any length are split whole; other columns pass, whatever their names; an empty table stays empty.
    """
    prepare(spark)
    n_lines, n_removed = "n_lines", "n_removed"
    held = [c for c in docs.columns if c.lower() in (n_lines, n_removed)]
    names = dict(zip(held, fresh(docs, *(f"_{c}" for c in held))))  # the operator would replace them
    out = line_dedup.dedup(docs.withColumnsRenamed(names))
    out = out.where((F.col(n_removed) == 0) | (line_dedup.trimmed(F.regexp_replace("text", r"\n", " ")) != ""))
    out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(n_lines, n_removed).withColumnsRenamed({new: old for old, new in names.items()}).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, null last.

    Rows that agree in doc_id and text are one.  Null, empty and blank texts
    are near nothing and all stay.  Texts of any length are compared whole; other columns pass, whatever their names; an empty table stays empty.
    """
    prepare(spark)
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or a row for each copy.

    Null, empty and blank texts have size 0; as all of one size they come as
    often as the whole copies of their stratum say.  Rows that agree in doc_id,
    source and size tie and are taken together; a null source is a source of its
    own.  Texts of any length are taken whole; other columns pass, whatever their names; an empty table stays empty.
    """
    prepare(spark)
    doc, source, size, copies, copy = fresh(docs, "_doc", "_source", "_size", "_copies", "_copy")
    taken = mix.mix(docs).where("copies > 0").select("doc_id", "source", "size", "copies").toDF(doc, source, size, copies)
    taken = sized(table(taken.distinct(), "mix-copies"), 96)
    same = docs["doc_id"].eqNullSafe(taken[doc]) & docs["source"].eqNullSafe(taken[source]) & (mix.size_of(docs["text"]) == taken[size])
    rows = docs.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return rows.select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256) of every row, repeated ones too.

    Null and empty texts have no tokens and the digests of no bytes; texts of
    any length are encoded whole; other columns are left out; an empty table stays empty.
    """
    prepare(spark)
    return token_digests(docs, "doc_id", "lang", "source")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: The classifier's tables can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, before)
        before = list({f.rsplit("/", 1)[0] for f in docs.inputFiles()})
    return STAGES[-1][1](spark, docs, sf_dir)
