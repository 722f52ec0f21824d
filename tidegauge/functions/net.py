"""Addresses: reserved ranges, source buckets, keyed hashes and entity tags."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 blocks that are not globally routable.
RESERVED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]


def ipv4_number(text: Column) -> Column:
    """The 32-bit number of a dotted address, or null."""
    parts = F.split(text, r"\.")
    good = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    number = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(good, number)


def routable_ipv4(text: Column) -> Column:
    """Outside all reserved blocks; null if it is no IPv4 address."""
    n = ipv4_number(text)
    out = F.lit(True)
    for block in RESERVED:
        net = ipaddress.ip_network(block)
        out = out & ~n.between(int(net.network_address), int(net.broadcast_address))
    return F.when(n.isNotNull(), out)


#: Blocks of either family that nothing is dialled in.
OUT_OF_SCOPE = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "224.0.0.0/3",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
]


def _groups(text: Column) -> Column:
    """The groups on one side of ``::``."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with ``value`` computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def ipv6_halves(text: Column) -> Column:
    """The upper and the lower 64 bits of an IPv6 address as signed longs, or null; a dotted tail counts as two groups."""
    none = F.array().cast("array<string>")

    def plain(text: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(text, r":([0-9.]+\.[0-9.]+)$", 1))
        dotted = once(tail, lambda n: F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(F.contains(text, F.lit(".")), dotted).otherwise(text)

    def padded(sides: Column) -> Column:
        """Eight groups, or another number if the address is none."""
        left, right = _groups(F.get(sides, F.lit(0))), F.when(F.size(sides) == 2, _groups(F.get(sides, F.lit(1)))).otherwise(none)
        return once(F.struct(left.alias("l"), right.alias("r")), lambda x: F.when(F.size(sides) == 1, x["l"]).when(
            (F.size(sides) == 2) & (F.size(x["l"]) + F.size(x["r"]) <= 7), F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"])))

    def halves(groups: Column) -> Column:
        half = lambda n, start: F.aggregate(F.slice(n, start, 4), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(x))
        numbers = F.transform(groups, lambda g: F.conv(g, 16, 10).try_cast("long"))
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(sound, once(numbers, lambda n: F.struct(half(n, 1).alias("hi"), half(n, 5).alias("lo"))))

    groups = once(F.split(plain(text), "::"), padded)
    return F.when(F.contains(text, F.lit(":")), once(groups, halves))


def address(text: Column) -> Column:
    """``(family, hi, lo)`` of an address of either family, or null. IPv4 is in the upper 32 bits of ``hi``; one mapped into IPv6 is IPv4."""
    made = lambda family, hi, lo: F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))
    zero = F.lit(0).cast("long")

    def six(x: Column) -> Column:
        mapped = (x["hi"] == 0) & (F.shiftrightunsigned(x["lo"], 32) == 0xFFFF)
        return F.when(mapped, made(4, F.shiftleft(x["lo"], 32), zero)).when(x.isNotNull(), made(6, x["hi"], x["lo"]))

    four = once(ipv4_number(text), lambda n: F.when(n.isNotNull(), made(4, F.shiftleft(n, 32), zero)))
    return F.when(F.contains(text, F.lit(":")), once(ipv6_halves(text), six)).otherwise(four)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def block_rows(blocks: list[str]) -> list[tuple[int, int, int, int]]:
    """``(family, length, hi, lo)`` of blocks, as :func:`address` has addresses."""
    out = []
    for block in blocks:
        net = ipaddress.ip_network(block)
        n = int(net.network_address) << 96 if net.version == 4 else int(net.network_address)
        out.append((net.version, net.prefixlen, _signed(n >> 64), _signed(n & (1 << 64) - 1)))
    return out


def prefix(hi: Column, lo: Column, length: Column) -> Column:
    """The first ``length`` bits of an address, the rest zero."""
    most = F.lit(-1).cast("long")
    mask = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, most).otherwise(F.call_function("shiftleft", most, (64 - n).cast("int")))
    return F.struct(hi.bitwiseAND(mask(length)).alias("hi"), lo.bitwiseAND(mask(length - 64)).alias("lo"))


def dialled_scope(text: Column) -> Column:
    """Outside all blocks of :data:`OUT_OF_SCOPE`; null if it is no address."""

    def outside(at: Column) -> Column:
        out = F.lit(True)
        for family, length, hi, lo in block_rows(OUT_OF_SCOPE):
            bits = prefix(at["hi"], at["lo"], F.lit(length))
            out = out & ~((at["family"] == family) & (bits["hi"] == hi) & (bits["lo"] == lo))
        return F.when(at.isNotNull(), out)

    return once(address(text), outside)


def source_bucket(text: Column) -> Column:
    """An IPv4 address itself, or the /64 of an IPv6 one, in its short form: the lower half and the zeros before it are left out."""

    def short(groups: Column) -> Column:
        last = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), lambda a, k: F.when(F.element_at(groups, k) != "0", k).otherwise(a))
        return F.concat(F.array_join(F.slice(groups, F.lit(1), last), ":"), F.lit("::/64"))

    def network(x: Column) -> Column:
        groups = F.array(*[F.lower(F.hex(F.shiftrightunsigned(x["hi"], 48 - 16 * k).bitwiseAND(0xFFFF))) for k in range(4)])
        return F.when(x.isNotNull(), once(groups, short))

    return F.when(F.contains(text, F.lit(":")), once(ipv6_halves(text), network)).when(ipv4_number(text).isNotNull(), text)


def keyed_hash(key: bytes, text: Column) -> Column:
    """HMAC-SHA-256 of a text's UTF-8 bytes in lower-case hexadecimal, as built-in expressions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def salt_epoch(at: Column) -> Column:
    """Which week since 1970 a salt is for."""
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 604_800)


def entity_tag(body: Column) -> Column:
    """URL-safe base64 of the SHA-256 of a body, in quotes."""
    return F.concat(F.lit('"'), F.translate(F.base64(F.unhex(F.sha2(body, 256))), "+/=", "-_"), F.lit('"'))
