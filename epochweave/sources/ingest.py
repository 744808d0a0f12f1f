"""Raw serialised records to columns, batch by batch: RLP headers and reward records, BCS records by a given layout."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from epochweave.functions.codec import read_rlp, read_uleb, uint

# Fixed values of the header's format: its items in order; with its proof-of-work hash, a stored header has that before the references.
HEADER = ("parent_hash", "height", "timestamp", "author", "transactions_root", "deferred_state_root", "deferred_receipts_root", "deferred_logs_bloom_hash", "blame", "difficulty", "adaptive", "gas_limit", "referee_hashes", "nonce")
POW_HASH_AT = 14
_HEADER_ROW = "hash binary, parent_hash binary, height bigint, timestamp bigint, author binary, transactions_root binary, deferred_state_root binary, deferred_receipts_root binary, deferred_logs_bloom_hash binary, blame bigint, difficulty binary, adaptive boolean, gas_limit binary, referee_hashes array<binary>, nonce binary, pow_hash binary, pos_ref binary, rest array<binary>"
_REWARD_ROW = "pos_epoch bigint, execution_hash binary, account_rewards array<struct<address:binary,pos_identifier:binary,reward:binary>>"


def _wide(raw: bytes) -> bytes:
    if len(raw) > 32:
        raise ValueError("a number of more than 256 bits")
    return bytes(raw).rjust(32, b"\0")


def header(value: bytes, pow_hash: bool = True) -> dict:
    """The fields of an RLP header. One stored with its proof-of-work hash has every item after the nonce one place further on."""
    items, end = read_rlp(value)
    if end != len(value) or not isinstance(items, list) or len(items) < POW_HASH_AT + pow_hash:
        raise ValueError("not a header")
    out = dict(zip(HEADER, items[:POW_HASH_AT], strict=True))
    for c in ("height", "timestamp", "blame"):
        out[c] = uint(out[c])
    out |= {"difficulty": _wide(out["difficulty"]), "gas_limit": _wide(out["gas_limit"]), "nonce": _wide(out["nonce"]), "adaptive": uint(out["adaptive"]) == 1}
    after = items[POW_HASH_AT + pow_hash :]
    if after and not isinstance(after[0], list):
        raise ValueError("the item where a reference stands is no list: is the proof-of-work hash in or out?")
    return out | {"pow_hash": items[POW_HASH_AT] if pow_hash else None, "pos_ref": after[0][0] if after and after[0] else None, "rest": [x for x in after[1:] if not isinstance(x, list)]}


def _decoded(raw: DataFrame, columns: list[str], schema: str, decode: Callable[..., dict | None]) -> DataFrame:
    """Rows of ``decode(*values)``, none where it gives None; what cannot be read is an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(raw.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                try:
                    found = decode(*values)
                except (IndexError, TypeError, ValueError, RecursionError) as e:
                    raise ValueError(f"a record cannot be read: {e}") from e
                if found is not None:
                    rows.append(found)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return raw.select(*columns).mapInArrow(run, schema)


def headers(raw: DataFrame, pow_hash: bool = True) -> DataFrame:
    """Header columns of (hash, value) records; ``rest`` are the items after the PoS reference that are no lists."""
    return _decoded(raw, ["hash", "value"], _HEADER_ROW, lambda h, v: {"hash": h} | header(v, pow_hash))


def reward_records(raw: DataFrame) -> DataFrame:
    """(pos_epoch, execution_hash, account_rewards) of (key, value) records: keys of eight bytes, big-endian. Records with other keys or no reward list in them are not rewards and are left out."""

    def decode(key: bytes, value: bytes) -> dict | None:
        try:
            accounts, execution = read_rlp(value)[0][:2]
            rewards = [{"address": a, "pos_identifier": i, "reward": _wide(r)} for a, i, r in accounts]
        except (IndexError, TypeError, ValueError):
            return None
        return {"pos_epoch": uint(key), "execution_hash": execution, "account_rewards": rewards} if len(key) == 8 and isinstance(execution, bytes) else None

    return _decoded(raw, ["key", "value"], _REWARD_ROW, decode)


def bcs(data: bytes, layout: list[tuple[str, str]]) -> dict:
    """The fields of a BCS record: kinds are u8, u64, u128, bool, bytes (a bounded length first), fixed:<n>, and option:<kind>. Bytes that are left are an error."""
    at, out = 0, {}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("a record ends too early")
        at += n
        return data[at - n : at]

    def read(kind: str):
        nonlocal at
        if kind in ("u8", "u64", "u128"):
            return int.from_bytes(take(int(kind[1:]) // 8), "little")
        if kind == "bool":
            (flag,) = take(1)
            if flag > 1:
                raise ValueError("neither true nor false")
            return flag == 1
        if kind == "bytes":
            size, at = read_uleb(data, at)
            return take(size)
        name, _, rest = kind.partition(":")
        if name == "fixed":
            return take(int(rest))
        if name == "option":
            return read(rest) if read("bool") else None
        raise ValueError(f"unknown kind {kind}")

    for name, kind in layout:
        out[name] = read(kind)
    if at != len(data):
        raise ValueError("a record goes on after its last field")
    return out


_KINDS = {"u8": "int", "u64": "bigint", "u128": "decimal(38,0)", "bool": "boolean", "bytes": "binary", "fixed": "binary"}


def bcs_records(raw: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """(hash, the fields of ``layout``) of (hash, value) records, as committed blocks are stored; the layout is the ledger's."""
    kind = lambda k: _KINDS[(k.removeprefix("option:")).partition(":")[0]]
    schema = "hash binary, " + ", ".join(f"{n} {kind(k)}" for n, k in layout)
    return _decoded(raw, ["hash", "value"], schema, lambda h, v: {"hash": h} | bcs(v, layout))
