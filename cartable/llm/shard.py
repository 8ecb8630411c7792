"""Hilbert-curve sharding with DataFrame functions only.

Several metadata dimensions are quantised to ``2^BITS`` bins of about equal row
counts, a row's bins become its place on a Hilbert curve, and the order along
the curve is cut into runs. Neighbours on the curve are close in every
dimension, so each shard has narrow ranges of all of them and readers can skip
files by any one.

Law ``rows``: shard sizes differ by at most one row. Order: curve index, then
id, then checksum of the text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered_index

BITS = 5
LAW = "rows"


def sortable(df: DataFrame, name: str) -> Column:
    """A number in the order of the column: numbers as they are, strings by
    their first seven bytes."""
    if df.schema[name].dataType.simpleString() == "string":
        head = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(name).cast("double")


def bins(df: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, Column]:
    """Bin of every dimension. The cut points are quantiles over all rows,
    ``2^bits - 1`` numbers a dimension on the driver; null goes to bin 0."""
    count = 1 << bits
    shares = [k / count for k in range(1, count)]
    row = df.agg(*[F.percentile_approx(sortable(df, d), shares, 10_000).alias(d) for d in dims]).first()
    out = {}
    for d in dims:
        cuts = sorted(set(row[d] or ()))
        x = sortable(df, d)
        # The same value always meets the same cuts, so ties share a bin.
        place = sum((F.when(x >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        out[d] = F.coalesce(place, F.lit(0)).cast("int")
    return out


def hilbert(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """Index on the Hilbert curve through the cells of ``axes`` (each below
    ``2^bits``). Bit arithmetic of Skilling's transform (2004): undo the
    rotations from the highest bit down, Gray-encode, interleave. Every step is
    one projection, so no expression holds another one twice."""
    x = [f"_x{i}" for i in range(len(axes))]
    df = df.withColumns({n: F.col(a).cast("bigint") for n, a in zip(x, axes, strict=True)})
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i, n in enumerate(x):
            high = F.col(n).bitwiseAND(q) != 0
            if i == 0:  # a dimension never swaps with itself
                df = df.withColumn(n, F.when(high, F.col(n).bitwiseXOR(F.lit(low))).otherwise(F.col(n)))
                continue
            swap = F.col(x[0]).bitwiseXOR(F.col(n)).bitwiseAND(low)
            df = df.withColumns({"_s": F.when(high, F.lit(0)).otherwise(swap),
                                 "_f": F.when(high, F.lit(low)).otherwise(F.lit(0))})
            df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.col("_s")).bitwiseXOR(F.col("_f")),
                                 n: F.col(n).bitwiseXOR(F.col("_s"))})
    for before, n in zip(x, x[1:], strict=False):
        df = df.withColumn(n, F.col(n).bitwiseXOR(F.col(before)))
    flip = F.lit(0)
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0))
    df = df.withColumn("_f", flip)
    df = df.withColumns({n: F.col(n).bitwiseXOR(F.col("_f")) for n in x})
    index = F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        for n in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(n, level).bitwiseAND(1))
    return df.withColumn(out, index).drop("_s", "_f", *x)


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 16, bits: int = BITS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` that of
    the empty text for null, ``slot`` the place inside the shard. Ties on the
    curve are cut like any other rows, so a hot value spreads over shards;
    repeated rows take slots of their own; an empty table gives no rows; only
    the id, the text and ``dims`` are read. Shuffles ids, sizes, checksums and
    curve indices, never texts.
    """
    place = bins(docs, dims, bits)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"),
                       F.crc32(raw).alias("text_crc32"), *[c.alias(f"_d{i}") for i, c in enumerate(place.values())])
    rows = hilbert(rows, [f"_d{i}" for i in range(len(dims))], bits, "curve").select("doc_id", "size", "text_crc32", "curve")
    scratch = Scratch(docs.sparkSession, "shard")
    ranked = ordered_index(rows, ["curve", "doc_id", "text_crc32"], scratch)
    total = docs.count()
    shard = F.floor(F.col("idx") * shards / F.lit(max(total, 1))) if total < 1 << 48 else \
        F.floor(F.col("idx").cast("decimal(38,0)") * shards / total)
    ranked = ranked.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")  # index of the shard's first row
    return ranked.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         (F.col("idx") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
