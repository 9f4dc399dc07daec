"""Helpers that several operators use."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.session import shared_dir

BROADCAST_ROWS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder that the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def broadcast_if_short(df: DataFrame) -> DataFrame:
    """``df`` written down, and sent to every task if it has few rows, so that what it is joined
    with stays in place; a longer one is joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole(text):
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text):
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def alnum_words(text):
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    parts = F.split(ascii_lower(whole(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def space_words(text):
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(whole(text), r"[\x20\x09-\x0D]+"), "")


def bind(value, body):
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is otherwise computed again for each element.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def no_spans():
    return F.array().cast(f"array<{_SPAN}>")


def find_spans(text, pattern):
    """Leftmost non-overlapping matches as (start, end, value), in code points.

    The matches and the gaps between them alternate, so their lengths add up to offsets.
    """
    def offsets(found):
        pairs = F.arrays_zip(
            F.slice(found["gaps"], F.lit(1), F.size(found["hits"])).alias("gap"),
            found["hits"].alias("hit"))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("out"))

        def step(state, pair):
            begin = state["at"] + F.char_length(pair["gap"])
            end = begin + F.char_length(pair["hit"])
            span = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        return F.aggregate(pairs, start, step, lambda state: state["out"])

    return bind(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                         F.split(text, pattern, -1).alias("gaps")), offsets)


def row_key(id_column="doc_id", text="text"):
    """Columns that name a row by its id and content; equal rows share them."""
    return F.col(id_column).alias("doc_id"), F.md5(whole(F.col(text))).alias("content")
