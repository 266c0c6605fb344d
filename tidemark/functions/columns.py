"""Column functions: key hashes, sizes, names, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 1 << 32


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (31) of a string's UTF-16 units, as a signed number; null stays null."""

    def step(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        above = point - 0x10000
        pair = h * 961 + (F.shiftright(above, 10) + 0xD800) * 31 + (above.bitwiseAND(0x3FF) + 0xDC00)
        return F.pmod(F.when(point > 0xFFFF, pair).otherwise(h * 31 + point), F.lit(TWO_32))

    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)
    return F.when(h >= TWO_32 // 2, h - TWO_32).otherwise(h)


def floor_mod(h: Column, n: int) -> Column:
    """The partition or set of a hash; -1 where there is none to choose from."""
    return F.pmod(h, F.lit(n)).cast("int") if n > 0 else F.lit(-1)


def key_partition(key: Column, n: int) -> Column:
    return floor_mod(java_hash(key), n)


def crc_set(key: Column, sets: int) -> Column:
    """The set of a key by the checksum of its bytes."""
    return floor_mod(F.crc32(F.encode(key, "utf-8")), sets)


def shard_size(size: Column, k: int) -> Column:
    """Bytes of each of k shards, the last padded with zeros."""
    return F.expr("0").cast("long") + F.floor((size + F.lit(k - 1)) / F.lit(k)).cast("long")


def decode_statistic(value: Column) -> Column:
    """0x... as the bytes it stands for, other text as it is; null stays null."""
    return F.when(value.startswith("0x"), F.decode(F.try_to_binary(F.substring(value, F.lit(3), F.length(value)), F.lit("hex")), "ISO-8859-1")).otherwise(value)


def version_name(version: Column) -> Column:
    return F.concat(F.lpad(version.cast("string"), 20, "0"), F.lit(".json"))


def version_of(name: Column) -> Column:
    """The version that a log file's name stands for; null for any other name."""
    return F.regexp_extract(name, r"(?:^|/)([0-9]{20})\.json$", 1).try_cast("long")


def range_request(offset: Column, length: Column) -> Column:
    return F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string"))


def bounded_name(base: Column, most: int = 58, suffix: int = 5) -> Column:
    """At most `most` characters of a name and a suffix from its hash, the same for the same name."""
    return F.concat(F.substring(base, 1, most), F.substring(F.sha2(base, 256), 1, suffix))


def csv_quoted(value: Column) -> Column:
    """Quoted where there is a comma, a quote or a line feed; quotes doubled; null is empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def as_declared(value: Column, kind: str) -> Column:
    """The value as its declared type; what isn't of one of the scalar types degrades to text."""
    return value.try_cast(kind) if kind in ("string", "int", "integer", "bigint", "long", "double", "float", "boolean") else value.cast("string")
