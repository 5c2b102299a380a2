"""From documents to token ids: five stages, each one operator over all that the stage before kept.

A stage's own tables, of which its result may read, stay until a later stage begins with documents that
read none of them: those were written. All stages take nulls, empty tables and columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm import bpe, jaccard_join, language_id, mixing, substring_dedup
from wavemill.llm.queries import table, vocabulary
from wavemill.llm.storage import Workspace

#: Texts below this share of n-grams that any learned language has are of none of them.
MIN_LANGUAGE_SCORE = 0.1
LOWEST = -(2**63)
_kept: list[Workspace] = []


def _begin(spark: SparkSession, docs: DataFrame, name: str) -> Workspace:
    """The stage's workspace; those of earlier stages go, if ``docs`` doesn't read them."""
    files = docs.inputFiles() if _kept else []
    for ws in list(_kept):
        if ws.spark is spark and not any(ws.root.rsplit("/", 1)[-1] in f for f in files):
            ws.drop_all()
            _kept.remove(ws)
    _kept.append(Workspace(spark, name))
    return _kept[-1]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as _row, so that no column can clash with a result."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or hardly an n-gram of any language; all others stay as they are.

    Null and empty texts have no letter. Rows with null id or lang are not learned from, but are judged;
    repeated rows are judged alike. Where no language can be learned, no document stays.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    seen = language_id.predict(_packed(docs), model)
    return seen.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("_row.*")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard similarity 0.75 connect, the document of the smallest id stays.

    Rows equal in id and text are one document; of them, the row with the smallest hash of all columns
    stays. Rows of one id but different texts share its fate. Null ids are one id, the smallest; null and
    empty texts are near nothing.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"), _begin(spark, docs, "stage-near"))
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("_d")).distinct()
    rows = _packed(docs).withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).join(stay, "_d", "left_semi")
    same = Window.partitionBy("_d", F.xxhash64("text")).orderBy(F.xxhash64("_row"))
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_row.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose words in windows of 20 that occurred earlier; a document that loses all its words goes.

    Null and empty texts stay as they are; null ids come first; rows equal in id and text lose the same.
    """
    cut = substring_dedup.deduplicate(_packed(docs), _begin(spark, docs, "stage-substring"), cut=True)
    cut = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target has it taken.

    The order is that of the rows in the files that the result is written to, by file number. Documents
    without words (null and empty texts) are never taken; a null source is a source; repeated rows are
    taken each for itself; ties of position go by id, taking and a hash of the row.
    """
    return mixing.curriculum(docs, _begin(spark, docs, "stage-mix"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 and the training order of each row: file, row.

    ``docs`` read from files give the number in the file's name and the place of the row in it; other
    ``docs`` have no order: both are null. Null texts have no tokens; repeated rows are encoded alike.
    """
    rows = docs.select("doc_id", "text")
    try:
        where = docs.metadataColumn("_metadata")
        number = F.regexp_extract(where["file_name"], r"part-(\d+)", 1)
        order = [F.when(number != "", number.cast("long")).alias("file"), where["row_index"].alias("row")]
        rows = docs.select("doc_id", "text", *order)
    except AnalysisException:  # not a scan of files
        rows = rows.withColumns({"file": F.lit(None).cast("long"), "row": F.lit(None).cast("long")})
    return bpe.encode(rows, *vocabulary(), _begin(spark, docs, "stage-bpe")).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "file", "row")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Learned filters, takings in the order of a hash, and BPE have no SQL form; a test compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
