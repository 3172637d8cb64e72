"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import WRITING, cut, discard, scratch, settings, shared_dir  # noqa: F401

#: White space in all operators: space and the ASCII controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    return F.array_remove(F.split(text, WS), "")


def term_table(digits: bool) -> bytes:
    """For bytes.translate(): A-Z become small, the bytes of terms stay (letters of ASCII, digits if wanted, and all of other characters), all others become spaces."""
    stay = lambda b: b > 127 or chr(b).islower() or digits and chr(b).isdigit()
    return bytes(b if stay(b) else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def terms(text: str | None, table: bytes) -> list[bytes]:
    """The terms of a text, in order, by a table of term_table()."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()
