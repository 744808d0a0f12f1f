"""Storage keys: canonical and per-period encodings, and back.

Kinds, as in the key column ``kind``: account, storage_root, storage,
code_root, code, deposit, vote, address_prefix, empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.functions.keccak import EMPTY, keccak, keccak256

# What follows the address, and the marker of the second space.
TAGS = {"account": b"", "storage_root": b"data", "storage": b"data", "code_root": b"code", "code": b"code", "deposit": b"deposit", "vote": b"vote"}
SPACE_MARK = b"\x81"
ADDRESS = 20


def period_padding(snapshot_root: bytes = EMPTY, intermediate_root: bytes = EMPTY) -> bytes:
    """The padding of a period: one hash of the roots before it; genesis has the roots of empty maps."""
    return keccak(snapshot_root + intermediate_root)


def _tag(kind: Column) -> Column:
    out = F.lit(None).cast("binary")
    for name, tag in TAGS.items():
        out = F.when(kind == name, F.lit(tag)).otherwise(out)
    return out


def _checked(kind: Column, address: Column, key: Column) -> Column:
    """``key``, or an error for an address of a length that the kind does not allow."""
    right = kind.isin("address_prefix", "empty") | (F.length(address) == ADDRESS) | ((kind == "account") & (F.length(address) < ADDRESS))
    return F.when(right, key).otherwise(F.raise_error(F.lit("an address has the wrong length")).cast("binary"))


def canonical_key(kind: Column, address: Column, suffix: Column, space: Column) -> Column:
    """address, tag, suffix; the ethereum space's mark stands after the address. Short accounts stay raw."""
    mark = F.when(space == "ethereum", F.lit(SPACE_MARK)).otherwise(F.lit(b""))
    full = F.concat(address, mark, _tag(kind), F.coalesce(suffix, F.lit(b"")))
    key = F.when(kind == "empty", F.lit(b"")).when((kind == "address_prefix") | (F.length(address) < ADDRESS), address).otherwise(full)
    return _checked(kind, address, key)


def with_delta_keys(df: DataFrame, padding: bytes, kind: str = "kind", address: str = "address", suffix: str = "suffix", space: str = "space") -> DataFrame:
    """``df`` with ``delta_key``. The hash of an address is made once per distinct address and joined back."""
    head = F.lit(padding[:12])
    hashed = df.where(F.length(address) == ADDRESS).select(address).distinct()
    hashed = hashed.withColumn("__account", F.concat(F.substring(keccak256(F.concat(head, F.col(address))), 1, 12), F.col(address))).withColumnRenamed(address, "__address")
    joined = df.join(hashed, F.col(address) == F.col("__address"), "left").drop("__address")
    is_storage = F.col(kind) == "storage"
    spread = F.when(is_storage, F.substring(keccak256(F.concat(F.lit(padding), F.coalesce(suffix, F.lit(b"")))), 5, 28)).otherwise(F.lit(b""))
    mark = F.when(F.col(space) == "ethereum", F.lit(SPACE_MARK)).otherwise(F.lit(b""))
    full = F.concat(F.col("__account"), mark, _tag(F.col(kind)), spread, F.coalesce(suffix, F.lit(b"")))
    key = F.when(F.col(kind).isin("address_prefix", "empty"), F.lit(b"")).when(F.length(address) < ADDRESS, F.col(address)).otherwise(full)
    return joined.withColumn("delta_key", _checked(F.col(kind), F.col(address), key)).drop("__account")


def _decoded(key: Column, start: int, spread: int, short: Column, short_kind: str) -> Column:
    """struct(kind, address, suffix, space) of a key whose address ends before byte ``start``."""
    rest = F.substr(key, F.lit(start + 1))
    marked = F.substring(rest, 1, 1) == F.lit(SPACE_MARK)
    body = F.when(marked, F.substr(rest, F.lit(2))).otherwise(rest)
    address = F.substring(key, start - ADDRESS + 1, ADDRESS)
    tail = F.substr(body, F.lit(5))
    of = lambda kind, suffix=None: F.struct(F.lit(kind).alias("kind"), address.alias("address"), (F.lit(None).cast("binary") if suffix is None else suffix).alias("suffix"), F.when(marked, "ethereum").otherwise("native").alias("space"))
    starts = lambda tag: F.substring(body, 1, len(tag)) == F.lit(tag)
    out = F.when(short, F.struct(F.lit(short_kind).alias("kind"), key.alias("address"), F.lit(None).cast("binary").alias("suffix"), F.lit("native").alias("space")))
    out = out.when(F.length(body) == 0, of("account")).when(body == F.lit(b"data"), of("storage_root")).when(body == F.lit(b"code"), of("code_root"))
    out = out.when(starts(b"deposit") if spread else body == F.lit(b"deposit"), of("deposit")).when(starts(b"vote") if spread else body == F.lit(b"vote"), of("vote"))
    storage = F.substr(tail, F.lit(spread + 1))
    out = out.when(starts(b"data") & (F.length(tail) >= spread), of("storage", storage)).when(starts(b"code"), of("code", tail))
    return out.otherwise(F.raise_error(F.lit("an unknown key")).cast("struct<kind:string,address:binary,suffix:binary,space:string>"))


def decode_canonical(key: Column) -> Column:
    """struct(kind, address, suffix, space); under 20 bytes it is an address prefix."""
    return _decoded(key, ADDRESS, 0, F.length(key) < ADDRESS, "address_prefix")


def decode_delta(key: Column) -> Column:
    """struct(kind, address, suffix, space); under 32 bytes it is a raw native account."""
    return _decoded(key, 32, 28, F.length(key) < 32, "account")
