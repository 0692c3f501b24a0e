"""Header bytes and header fields as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schema import FLAG_BITS, FLAG_LETTERS


def be16(data: Column, offset: int | Column) -> Column:
    """Unsigned big-endian 16 bits at a 0-based byte offset."""
    return F.conv(F.hex(F.substring(data, F.lit(offset) + 1, F.lit(2))), 16, 10).cast("int")


def byte_at(data: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(data, offset + 1, 1)), 16, 10).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ones_complement(data: Column) -> Column:
    """Internet checksum: complement of the folded sum of 16-bit words, odd input padded with 0."""

    def of_hex(digits: Column) -> Column:
        places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s + F.conv(F.rpad(F.substring(digits, i, F.lit(4)), 4, "0"), 16, 10).cast("long"))

    folded = lambda total: F.when(total == 0, F.lit(0).cast("long")).otherwise((total - 1) % 65535 + 1)
    return bound(bound(F.hex(data), of_hex), lambda total: (F.lit(65535) - folded(total)).cast("int"))


def ipv4_checksum_ok(header: Column) -> Column:
    """1 or 0 for a header of ihl * 4 bytes; NULL for anything shorter than 20 bytes."""

    def ok(h: Column) -> Column:
        bare = F.concat(F.substring(h, 1, 10), F.lit(b"\x00\x00"), F.substring(h, F.lit(13), F.length(h)))
        return F.when(F.length(h) >= 20, (ones_complement(bare) == be16(h, 10)).cast("int"))

    return bound(header, ok)


def ip_bytes(ip: Column) -> Column:
    """Dotted IPv4 as 4 bytes."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.hex(p.cast("long")), 2, "0"))
    return F.unhex(F.array_join(parts, ""))


def l4_checksum_ok(version: Column, proto: Column, src: Column, dst: Column, segment: Column) -> Column:
    """Checksum of a TCP or UDP segment under its pseudo header; src and dst are 4 or 16 bytes.

    NULL if the packet is not IP or not TCP or UDP.  A UDP checksum of 0 counts as any other.
    """
    at = F.when(proto == 6, F.lit(16)).otherwise(F.lit(6))

    def ok(data: Column) -> Column:
        size = F.hex(F.length(data).cast("long"))
        v4 = F.concat(src, dst, F.lit(b"\x00"), F.unhex(F.lpad(F.hex(proto.cast("long")), 2, "0")), F.unhex(F.lpad(size, 4, "0")))
        v6 = F.concat(src, dst, F.unhex(F.lpad(size, 8, "0")), F.lit(b"\x00\x00\x00"), F.unhex(F.lpad(F.hex(proto.cast("long")), 2, "0")))
        bare = F.concat(F.substring(data, F.lit(1), at), F.lit(b"\x00\x00"), F.substring(data, at + 3, F.length(data)))
        stored = F.conv(F.hex(F.substring(data, at + 1, F.lit(2))), 16, 10).cast("int")
        return (ones_complement(F.concat(F.when(version == 4, v4).when(version == 6, v6), bare)) == stored).cast("int")

    return F.when(version.isin(4, 6) & proto.isin(6, 17), bound(segment, ok))


def dscp(tos: Column) -> Column:
    return F.shiftright(tos, 2).bitwiseAND(63)


def ecn(tos: Column) -> Column:
    return tos.bitwiseAND(3)


def fragment_fields(word: Column) -> dict[str, Column]:
    """df, mf and the offset in 8-byte units of a flags and fragment word."""
    return {
        "ip_flags_df": F.shiftright(word, 14).bitwiseAND(1),
        "ip_flags_mf": F.shiftright(word, 13).bitwiseAND(1),
        "ip_frag_off": word.bitwiseAND(0x1FFF),
    }


def ihl_bytes(first_byte: Column) -> Column:
    return first_byte.bitwiseAND(15) * 4


def tcp_header_bytes(offset_byte: Column) -> Column:
    return F.shiftright(offset_byte, 4).bitwiseAND(15) * 4


def ethertype_hex(value: Column) -> Column:
    digits = F.lower(F.hex(value.cast("long")))
    return F.concat(F.lit("0x"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def flag_letters(flags: Column) -> dict[str, Column]:
    """tcp_flag_* bits of a letter string; NULL counts as no flag."""
    text = F.upper(F.coalesce(flags, F.lit("")))
    return {f"tcp_flag_{n}": F.contains(text, F.lit(x)).cast("int") for n, x in FLAG_LETTERS.items()}


def flag_bits(value: Column) -> dict[str, Column]:
    """tcp_flag_* bits of a numeric flag field; NULL and NaN count as 0."""
    number = F.when(F.isnan(value.cast("double")), None).otherwise(value).cast("int")
    return {f"tcp_flag_{n}": (F.coalesce(number, F.lit(0)).bitwiseAND(b) != 0).cast("int") for n, b in FLAG_BITS.items()}


def hex_preview(data: Column, size: int | None = None) -> Column:
    """Bytes as lower-case hex pairs with blanks between."""
    part = data if size is None else F.substring(data, 1, size)
    return F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))


def ts_local(ts_us: Column) -> Column:
    """' yyyy-MM-dd HH:mm:ss.SSS', milliseconds cut off, in the session's time zone."""
    return F.concat(F.lit(" "), F.date_format(F.timestamp_micros(F.floor(ts_us / 1000).cast("long") * 1000), "yyyy-MM-dd HH:mm:ss.SSS"))


def public_ipv4(ip: Column) -> Column:
    """True for a public routable IPv4 address; False for others and for anything else."""
    fine = F.rlike(ip, F.lit(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"))
    number_of = lambda text: reduce(lambda n, part: n * 256 + part, (int(x) for x in text.split(".")))

    def public(number: Column) -> Column:
        inside = F.lit(False)
        for net, bits in NOT_PUBLIC_V4:
            inside = inside | number.between(number_of(net), number_of(net) + 2 ** (32 - bits) - 1)
        return ~inside | number.isin(*map(number_of, PUBLIC_WITHIN_V4))

    # Bound, as the number would be split out of the text anew for each block, by code too large to compile.
    number = bound(F.split(ip, r"\."), lambda parts: reduce(lambda n, k: n * 256 + parts[k].cast("long"), range(1, 4), parts[0].cast("long")))
    return F.coalesce(F.when(fine, bound(number, public)), F.lit(False))


# Private, loopback, link-local, multicast, reserved and unspecified blocks.
NOT_PUBLIC_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
]
PUBLIC_WITHIN_V4 = ["192.0.0.9", "192.0.0.10"]
# End of fixed values.


# Of 2000::/3, the blocks that are not public, and those inside them that are.  Outside it only fec0::/10 counts as public.
NOT_PUBLIC_V6 = ["2001::/23", "2001:db8::/32", "2002::/16"]
PUBLIC_WITHIN_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
# End of fixed values.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TAIL = rf"((?:{_OCTET}\.){{3}}{_OCTET})$"
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})"
_SHAPE = rf"^(?:{_GROUPS}{{7}}|(?:{_GROUPS}*)?::(?:{_GROUPS}*)?)$"


def ipv6_digits(text: Column) -> Column:
    """The 32 lower-case hex digits of an IPv6 address, with a dotted tail or a zone or not; NULL for anything else."""

    def with_hex_tail(plain: Column) -> Column:
        tail = F.regexp_extract(plain, _TAIL, 1)
        digits = F.lower(F.hex(ip_bytes(tail)))
        return F.when(tail != "", F.concat(F.regexp_replace(plain, _TAIL, ""), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))).otherwise(plain)

    def whole(groups: Column) -> Column:
        sides = F.split(groups, "::")
        side = lambda k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
        filled = lambda k: F.array_join(F.transform(side(k), lambda g: F.lpad(g, 4, "0")), "")
        zeros = F.repeat(F.lit("0000"), 8 - F.size(side(0)) - F.size(side(1)))
        most = F.when(F.contains(groups, F.lit("::")), 7).otherwise(8)
        return F.when(F.rlike(groups, F.lit(_SHAPE)) & (F.size(side(0)) + F.size(side(1)) <= most), F.concat(filled(0), zeros, filled(1)))

    return bound(bound(F.regexp_replace(F.lower(text), "%[^%]+$", ""), with_hex_tail), whole)


def _in_block(digits: Column, block: str) -> Column:
    """Whether 128 bits, as 32 hex digits, lie in a block: such texts stand in the order of their numbers."""
    import ipaddress

    net = ipaddress.ip_network(block)
    return digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")


def public_ipv6(text: Column) -> Column:
    """Whether an IPv6 address is public.  False for mapped IPv4 addresses and for what is no address."""

    def public(digits: Column) -> Column:
        some = lambda blocks: reduce(lambda a, b: a | b, (_in_block(digits, x) for x in blocks))
        return _in_block(digits, "2000::/3") & (~some(NOT_PUBLIC_V6) | some(PUBLIC_WITHIN_V6)) | _in_block(digits, "fec0::/10")

    return F.coalesce(bound(ipv6_digits(text), public), F.lit(False))


def public_ip(ip: Column) -> Column:
    """Whether an address of either family is public, in column expressions."""
    text = F.trim(ip)
    return F.when(F.contains(text, F.lit(":")), public_ipv6(text)).otherwise(public_ipv4(text))
