"""A corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens. Each stage reads what the one before wrote.

All stages but the last return the columns of their documents; a stage's rows are decided on its own input. Rows that a
stage keeps are kept whole, except that the mix cuts a document where a block that it draws begins or ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, mixing, quality, simhash, toxicity
from ravelin.llm.common import cut, fresh_name, map_rows, release, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; fitted on those of its input that are labelled.

    A null text is scored as an empty one, whole texts of any length count; rows whose score is the threshold stay, repeated
    rows fare alike, an empty table and one without labels of both classes are kept as they are."""
    score = quality.score_of(spark, quality.fit(docs, table(spark, sf_dir, "labels")))
    release()  # what fitting took of the driver
    return docs.where(score(docs["text"]) >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; fitted on those of its input that are labelled.

    Null and empty texts have the score of a text without known words; rows whose score is 0.5 go, repeated rows fare alike,
    an empty table and one without labels of both classes are kept as they are."""
    score = toxicity.score_of(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    release()  # what fitting took of the driver
    return docs.where(score(docs["text"]) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 4/5 or more of five-word shingles join: that of the least id.

    A null id comes after all others; rows of one id are ordered by hashes of their text, then of the whole row. Null texts
    count as empty, and texts without words are one group."""
    hashed = simhash.with_hashes(docs)
    row = ["t1", "t2", "row_hash"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *row)
    firsts = cut(simhash.similar_groups(hashed).groupBy("group", "part").agg(F.min(order).alias("first")).select(*[F.col(f"first.{c}").alias(f"first_{c}") for c in row]))
    same = [hashed[c] == firsts[f"first_{c}"] for c in row]
    joined = hashed.join(firsts.hint("merge"), same, "left_semi")
    return joined.dropDuplicates(row).select("doc.*")  # of equal rows one


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: for each pass over a document a row for each run of words taken, with the text that they span.

    Null, empty and wordless texts are never taken; a long text may be cut where a block ends; a null source is a source,
    repeated rows are documents of their own, an empty table gives an empty one. Other columns are kept, n_chars follows."""
    kind = docs.schema
    columns = docs.columns
    at = columns.index("text")
    length = columns.index("n_chars") if "n_chars" in columns else None
    pieces = mixing.plan(docs).select("doc", F.transform("pieces", lambda p: F.struct(p["pass"].alias("pass"), p["word_from"], p["word_to"])).alias("pieces"))

    def start():
        import re

        words = re.compile(r"[^\x20\x09-\x0D]+").finditer

        def each(doc, taken):
            runs: list[list[int]] = []
            for piece in sorted(taken, key=lambda p: (p["pass"], p["word_from"])):
                number, low, high = piece["pass"], piece["word_from"], piece["word_to"]
                if runs and runs[-1][0] == number and runs[-1][2] == low:
                    runs[-1][2] = high
                else:
                    runs.append([number, low, high])
            if not runs:
                return
            row = [doc[c] for c in columns]
            spans = [m.span() for m in words(row[at])]
            for _, low, high in runs:
                whole = low == 0 and high == len(spans)
                text = row[at] if whole else row[at][spans[low][0] : spans[high - 1][1]]
                own = list(row)
                own[at] = text
                if length is not None and not whole:
                    own[length] = len(text)
                yield tuple(own)

        return each

    return map_rows(pieces.where(F.size("pieces") > 0), ["doc", "pieces"], start, kind)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of each row, with their number and the digests that tell whether they decode to the text.

    A null text has the ids of an empty one, none; a null doc_id and repeated rows are kept, other columns aren't read, an
    empty table gives an empty one."""
    return bpe.encode(docs, emit=bpe.ids_and_digests, emitted="n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/{fresh_name('pipeline')}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Classifiers trained here can't be put in SQL.
ORACLE_SQL = None
