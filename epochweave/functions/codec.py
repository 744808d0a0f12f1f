"""Binary codec functions: native columns where Spark can express them, small helpers where bytes must be walked."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the packet format.
FLAG_ADAPTIVE, FLAG_PIVOT, FLAG_ESPACE, FLAG_HAS_TRANSACTIONS = 1, 2, 4, 8
FLAG_TX_COMPRESSED, FLAG_SKIPPED_EXECUTION, FLAG_ZERO_TOTAL_REWARD = 16, 32, 64
FLAGS = {
    "adaptive": FLAG_ADAPTIVE,
    "pivot": FLAG_PIVOT,
    "espace": FLAG_ESPACE,
    "has_transactions": FLAG_HAS_TRANSACTIONS,
    "tx_compressed": FLAG_TX_COMPRESSED,
    "skipped": FLAG_SKIPPED_EXECUTION,
    "zero_total_reward": FLAG_ZERO_TOTAL_REWARD,
}
GAS_LIMITS = {0: 0, 1: 30_000_000, 2: 60_000_000}
CORE_PRICE, ESPACE_PRICE = 1_000_000_000, 20_000_000_000


# Columns.


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def uleb_length(v: Column) -> Column:
    """Bytes of a non-negative long, or whole decimal, in groups of 7 bits; 10 at most, as values have 64 bits."""
    longer = [F.when(v >= F.lit(Decimal(1 << 63) if n == 9 else 1 << 7 * n), n + 1) for n in range(1, 10)]
    return F.greatest(F.lit(1), F.when(v < 0, 10), *longer)


def qc5e_length(v: Column, known: dict[int, int]) -> Column:
    """Bytes of a quick-coded value (a non-negative long or whole decimal): one if ``known`` (code to value) has it, else 5, 6 or 7; null where 54 bits do not hold it."""
    enum = F.coalesce(v.isin(list(known.values())), F.lit(False))
    return F.when(enum, 1).when(v < 0, F.lit(None)).when(v < 1 << 38, 5).when(v < 1 << 46, 6).when(v < 1 << 54, 7)


def gas_limit_code(v: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, value in GAS_LIMITS.items():
        out = F.when(v == value, code).otherwise(out)
    return out


def gas_limit_value(code: Column) -> Column:
    """Value of an enum code; unknown codes mean 0."""
    return F.when(code == 1, F.lit(GAS_LIMITS[1])).when(code == 2, F.lit(GAS_LIMITS[2])).otherwise(F.lit(0)).cast("long")


def base_price_code(v: Column, espace: Column) -> Column:
    usual = F.when(espace, F.lit(ESPACE_PRICE)).otherwise(F.lit(CORE_PRICE))
    return F.when(v == 0, 0).when(v == usual, 1)


def base_price_value(code: Column, espace: Column) -> Column:
    return F.when(code == 1, F.when(espace, F.lit(ESPACE_PRICE)).otherwise(F.lit(CORE_PRICE))).otherwise(F.lit(0)).cast("long")


def aligned(n: Column, to: int) -> Column:
    return n + F.pmod(-n, F.lit(to))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def set_flags(**tests: Column) -> Column:
    """The flag bits whose tests hold; null does not hold."""
    out = F.lit(0)
    for name, test in tests.items():
        out = out.bitwiseOR(F.when(test, FLAGS[name]).otherwise(0))
    return out


def block_flags(adaptive: Column, pivot: Column, height: Column, ratio: int, skipped: Column, total_reward: Column) -> Column:
    """Flags of a block; a missing reward counts as zero."""
    return set_flags(adaptive=adaptive, pivot=pivot, espace=pivot & (height % ratio == 0), skipped=skipped, zero_total_reward=F.coalesce(total_reward, F.lit(0)) == 0)


def nibbles(key: Column) -> Column:
    """A key as its hex digits: one character a nibble."""
    return F.hex(key)


def from_nibbles(digits: Column) -> Column:
    return F.unhex(digits)


def prefix_end(key: Column) -> Column:
    """Exclusive end, in nibble space, of all keys that start with ``key``: 'g' follows every hex digit."""
    return F.concat(F.lower(F.hex(key)), F.lit("g"))


def packed_nibbles(digits: Column, odd_start: Column) -> Column:
    """A nibble path in bytes: an odd start puts the first nibble in a byte of its own; a dangling last one is the high half."""
    lead = F.when(odd_start & (F.length(digits) > 0), F.concat(F.lit("0"), F.substring(digits, 1, 1))).otherwise(F.lit(""))
    rest = F.when(odd_start & (F.length(digits) > 0), F.substr(digits, F.lit(2))).otherwise(digits)
    return F.unhex(F.concat(lead, rest, F.when(F.length(rest) % 2 == 1, F.lit("0")).otherwise(F.lit(""))))


def little_endian(b: Column) -> Column:
    """Unsigned little-endian bytes (up to 8) as a long."""
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def big_endian32(v: Column) -> Column:
    """A non-negative long or decimal of up to 38 digits as 32 bytes."""
    low, high = F.pmod(v.cast("decimal(38,0)"), F.lit(1 << 60).cast("decimal(38,0)")), F.floor(v.cast("decimal(38,0)") / F.lit(1 << 60).cast("decimal(38,0)"))
    return F.unhex(F.lpad(F.concat(F.hex(high.cast("long")), F.lpad(F.hex(low.cast("long")), 15, "0")), 64, "0"))


def long32(v: Column) -> Column:
    """A non-negative long as 32 bytes, big-endian: ``big_endian32`` without decimals."""
    return _long_bytes(v, 32)


def long20(v: Column) -> Column:
    """A non-negative long as the 20 bytes of an address, big-endian."""
    return _long_bytes(v, 20)


def _long_bytes(v: Column, n: int) -> Column:
    # Filled up as bytes: as hex digits it takes five times as long.
    return F.lpad(F.unhex(F.hex(v.cast("long"))), F.lit(n), F.lit(b"\0"))


def padded_hash(prefix: Column) -> Column:
    """A 4-byte hash prefix, zero-filled to 32 bytes."""
    return F.unhex(F.rpad(F.hex(prefix), 64, "0"))


# Bytes.


def put_uleb(out: bytearray, v: int) -> None:
    if v < 0 or v >> 64:
        raise ValueError("not an unsigned 64-bit value")
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


def read_uleb(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); at most 10 bytes."""
    if at < len(data) and data[at] < 128:
        return data[at], at + 1
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise ValueError("a number ends too early")
        value |= (data[at + i] & 127) << (7 * i)
        if data[at + i] < 128:
            return value, at + i + 1
    raise ValueError("a number is too long")


def put_qc8(out: bytearray, v: int) -> None:
    """Two bits of length, then 62, 70, 78 or 86 bits, most significant first."""
    mode = next((m for m in range(4) if not v >> (62 + 8 * m)), None)
    if mode is None or v < 0:
        raise ValueError("does not fit 86 bits")
    size = 8 + mode
    out += (mode << (8 * size - 2) | v).to_bytes(size, "big")


def read_qc8(data: bytes, at: int) -> tuple[int, int]:
    size = 8 + (data[at] >> 6)
    if at + size > len(data):
        raise ValueError("a number ends too early")
    return int.from_bytes(data[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


def put_qc5e(out: bytearray, v: int, code: int | None) -> None:
    """One byte for an enum code, else two bits of length and 38, 46 or 54 bits."""
    if code is not None:
        out.append(code & 63)
        return
    mode = next((m for m in range(1, 4) if not v >> (30 + 8 * m)), None)
    if mode is None or v < 0:
        raise ValueError("does not fit 54 bits")
    out += (mode << (8 * (4 + mode) - 2) | v).to_bytes(4 + mode, "big")


def read_qc5e(data: bytes, at: int) -> tuple[int | None, int | None, int]:
    """(enum code, value, next position): one of the first two."""
    mode = data[at] >> 6
    if not mode:
        return data[at] & 63, None, at + 1
    size = 4 + mode
    if at + size > len(data):
        raise ValueError("a number ends too early")
    return None, int.from_bytes(data[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


# RLP: byte strings and lists.


def rlp(item) -> bytes:
    """Bytes, non-negative ints and nested lists."""
    if isinstance(item, list | tuple):
        return rlp_list([rlp(x) for x in item])
    if isinstance(item, int):
        return _SMALL[item] if 0 <= item < 128 else _rlp_bytes(item.to_bytes((item.bit_length() + 7) // 8, "big"))
    return _rlp_bytes(item)


def rlp_list(encoded: list[bytes]) -> bytes:
    """A list of items that are encoded already."""
    body = b"".join(encoded)
    return (_LISTS[len(body)] if len(body) < 56 else _rlp_head(len(body), 0xC0)) + body


def _rlp_bytes(item: bytes) -> bytes:
    n = len(item)
    if n == 1 and item[0] < 128:
        return bytes(item)
    return (_STRINGS[n] if n < 56 else _rlp_head(n, 0x80)) + item


def _rlp_head(n: int, base: int) -> bytes:
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([base + 55 + len(size)]) + size


_STRINGS, _LISTS = [bytes([0x80 + n]) for n in range(56)], [bytes([0xC0 + n]) for n in range(56)]
_SMALL = [bytes([n or 0x80]) for n in range(128)]


def read_rlp(data: bytes, at: int = 0):
    """(item, next position): lists stay lists, all else is bytes."""
    head = data[at]
    if head < 128:
        return data[at : at + 1], at + 1
    base = 0x80 if head < 0xC0 else 0xC0
    n, start = head - base, at + 1
    if n > 55:
        start += n - 55
        n = int.from_bytes(data[at + 1 : start], "big")
    end = start + n
    if end > len(data):
        raise ValueError("an item ends too early")
    if base == 0x80:
        return data[start:end], end
    out = []
    while start < end:
        head = data[start]
        if head < 128:  # one byte, and then a short string: most items of a list
            out.append(data[start : start + 1])
            start += 1
        elif head < 0xB8:
            stop = start + head - 0x7F
            if stop > len(data):
                raise ValueError("an item ends too early")
            out.append(data[start + 1 : stop])
            start = stop
        else:
            item, start = read_rlp(data, start)
            out.append(item)
    return out, end


def uint(raw: bytes) -> int:
    return int.from_bytes(raw, "big")
