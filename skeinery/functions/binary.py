"""Decoders of the wire formats: bencode, DHT messages, info dictionaries, text of unknown encoding."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 100


class Malformed(ValueError):
    """Not one well-formed bencode value within the depth limit."""


def bdecode(data: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """One bencode value and the place after it; bounds and depth are checked before anything is built."""
    if at >= len(data):
        raise Malformed("ends early")
    lead = data[at : at + 1]
    if lead in (b"d", b"l"):
        if depth >= MAX_DEPTH:
            raise Malformed("too deep")
        at += 1
        items: list[object] = []
        while data[at : at + 1] != b"e":
            value, at = bdecode(data, at, depth + 1)
            items.append(value)
        if lead == b"l":
            return items, at + 1
        if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
            raise Malformed("dictionary keys")
        return dict(zip(items[::2], items[1::2])), at + 1
    if lead == b"i":
        end = data.find(b"e", at)
        digits = data[at + 1 : end] if end > 0 else b""
        if not digits.removeprefix(b"-").isdigit():
            raise Malformed("integer")
        return int(digits), end + 1
    colon = data.find(b":", at, at + 12)
    if colon < 0 or not data[at:colon].isdigit():
        raise Malformed("string length")
    end = colon + 1 + int(data[at:colon])
    if end > len(data):
        raise Malformed("string beyond the end")
    return data[colon + 1 : end], end


def value_length(data: bytes | None) -> int | None:
    """Bytes of the first value in ``data``; None if it isn't well formed."""
    if data is None:
        return None
    try:
        return bdecode(data)[1]
    except Malformed:
        return None


def _address(b: bytes) -> tuple[str, int]:
    return ".".join(map(str, b[:4])), int.from_bytes(b[4:6], "big")


def compact_nodes(b: bytes) -> list[tuple[str, int]]:
    """26-byte records (id, IPv4, port) without port 0 and 0.0.0.0."""
    found = (_address(b[i + 20 : i + 26]) for i in range(0, len(b) - 25, 26))
    return [(ip, port) for ip, port in found if port and ip != "0.0.0.0"]


def peer_values(items: object, most: int = 64) -> list[tuple[str, int]]:
    """6-byte peers without port 0, 0.0.0.0 and loopback; the first 64."""
    if not isinstance(items, list):
        return []
    found = (_address(b) for b in items if isinstance(b, bytes) and len(b) == 6)
    return [(ip, port) for ip, port in found if port and ip != "0.0.0.0" and not ip.startswith("127.")][:most]


def samples(b: bytes) -> list[str]:
    return [b[i : i + 20].hex() for i in range(0, len(b) - 19, 20)]


MESSAGE = "kind string, method string, txid string, info_hash string, port int, implied_port boolean, nodes array<struct<ip:string,port:int>>, peers array<struct<ip:string,port:int>>, samples array<string>, reported_ip string"
_FIELDS = [f.strip().split(" ")[0] for f in MESSAGE.replace("ip:string,port:int", "").split(", ")]


def dht_message(packet: bytes | None) -> dict | None:
    """A query, a response or 'other'; None for what is no message."""
    try:
        d, _ = bdecode(packet or b"")
    except Malformed:
        return None
    if not isinstance(d, dict):
        return None
    text = lambda v: v.hex() if isinstance(v, bytes) else ""
    out: dict = dict.fromkeys(_FIELDS) | {"kind": "other"}
    if d.get(b"y") == b"q":
        a = d.get(b"a") if isinstance(d.get(b"a"), dict) else {}
        method, port, target = d.get(b"q"), a.get(b"port"), a.get(b"info_hash")
        known = {b"ping", b"find_node", b"get_peers", b"announce_peer"}
        out |= {
            "kind": "query",
            "txid": text(d.get(b"t")),
            "method": method.decode() if isinstance(method, bytes) and method in known else "other",
            "info_hash": target.hex() if isinstance(target, bytes) and len(target) == 20 else None,
            "port": port if isinstance(port, int) and 0 <= port <= 65_535 else None,
            "implied_port": isinstance(a.get(b"implied_port"), int) and a[b"implied_port"] != 0,
        }
    elif d.get(b"y") == b"r":
        r = d.get(b"r") if isinstance(d.get(b"r"), dict) else {}
        raw = lambda k: r[k] if isinstance(r.get(k), bytes) else b""
        ip = d.get(b"ip")
        out |= {
            "kind": "response",
            "txid": text(d.get(b"t")),
            "nodes": compact_nodes(raw(b"nodes")),
            "peers": peer_values(r.get(b"values")),
            "samples": samples(raw(b"samples")),
            "reported_ip": ".".join(map(str, ip[:4])) if isinstance(ip, bytes) and len(ip) >= 4 else None,
        }
    return out


#: Encodings tried for bytes that are not UTF-8, in order.
LEGACY = ("gb18030", "shift_jis", "euc_kr", "cp1251", "cp1254", "cp1252")


def _guessed(b: bytes) -> str | None:
    """A decoding that shows a writing system so clearly that others need not be weighed."""

    def beyond_ascii(encoding: str) -> str:
        try:
            return "".join(c for c in b.decode(encoding) if ord(c) > 127)
        except UnicodeDecodeError:
            return ""

    cyrillic = beyond_ascii("cp1251")
    if cyrillic and all("\u0400" <= c <= "\u045f" for c in cyrillic):
        words = re.findall("[\u0400-\u045f]+", b.decode("cp1251"))
        if all(w[1:].islower() or w.isupper() or len(w) == 1 for w in words) and any(len(w) > 2 for w in words):
            return "cp1251"
    hangul = beyond_ascii("euc_kr")
    if hangul and all("\uac00" <= c <= "\ud7a3" for c in hangul):
        return "euc_kr"
    japanese = beyond_ascii("shift_jis")
    if sum("\u3040" <= c <= "\u30ff" for c in japanese) * 5 >= max(1, len(japanese)):
        return "shift_jis"
    return None


def legacy_text(b: bytes | None) -> str | None:
    """UTF-8 if valid, else a clear guess, else the error-free legacy decoding with the largest share of letters."""
    if b is None:
        return None
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if guess := _guessed(b):
        return b.decode(guess)
    best, most = None, -1.0
    for encoding in LEGACY:
        try:
            s = b.decode(encoding)
        except UnicodeDecodeError:
            continue
        share = sum(c.isalnum() or c.isspace() or c in ".-_[]()" for c in s) / max(1, len(s))
        if share > most + 1e-6:
            best, most = s, share
    return best if best is not None else b.decode("utf-8", "replace")


INFO = "name string, total_size bigint, files array<struct<path:string,size:bigint>>, error string"


def _text_field(d: dict, key: bytes) -> str | None:
    """The UTF-8 variant of a field if it is valid and not blank, else the field itself."""
    own = d.get(key + b".utf-8")
    if isinstance(own, bytes):
        try:
            if (s := own.decode("utf-8")).strip():
                return s
        except UnicodeDecodeError:
            pass
    plain = d.get(key)
    return legacy_text(plain) if isinstance(plain, bytes) else None


def info_record(data: bytes | None) -> dict:
    """Name, total size and files of an info dictionary, or the reason why it is none."""
    failed = lambda why: {"name": None, "total_size": None, "files": None, "error": why}
    if data is None or value_length(data) != len(data):
        return failed("bencode")
    d, _ = bdecode(data)
    if not isinstance(d, dict):
        return failed("not a dictionary")
    name = _text_field(d, b"name")
    if name is None:
        return failed("name")
    entries, length = d.get(b"files"), d.get(b"length")
    files: list[tuple[str, int]] = []
    if isinstance(entries, list):
        for e in entries:
            if not isinstance(e, dict):
                return failed("files entry")
            size, parts = e.get(b"length"), e.get(b"path.utf-8", e.get(b"path"))
            if not isinstance(size, int) or size < 0:
                return failed("files.length")
            if not isinstance(parts, list):
                return failed("files.path")
            files.append(("/".join([name, *(legacy_text(p) or "" for p in parts if isinstance(p, bytes))]), size))
    elif isinstance(length, int):
        if length < 0:
            return failed("length")
        files.append((name, length))
    else:
        return failed("neither length nor files")
    total = min(sum(s for _, s in files), (1 << 63) - 1)
    return {"name": name, "total_size": total, "files": files, "error": None}


def verified(info: Column, content_id: Column) -> Column:
    """Do the bytes hash (SHA-1) to the content id?"""
    return F.sha1(info) == F.lower(content_id)


def assemble(pieces: list[tuple[int, bytes]]) -> tuple[bytes, str]:
    """Pieces in order as one buffer, and its SHA-1."""
    whole = b"".join(p for _, p in sorted(pieces))
    return whole, hashlib.sha1(whole).hexdigest()


def _message_batch(packets: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dht_message(p) or dict.fromkeys(_FIELDS) for p in packets], columns=_FIELDS).astype({"port": "Int32"})


def _info_batch(infos: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([info_record(i) for i in infos], columns=["name", "total_size", "files", "error"]).astype({"total_size": "Int64"})


def _legacy_batch(values: pd.Series) -> pd.Series:
    return pd.Series([legacy_text(v) for v in values], dtype=object)


def _length_batch(values: pd.Series) -> pd.Series:
    return pd.Series([value_length(v) for v in values], dtype="Int32")


def decoded_message(packet: Column) -> Column:
    return F.pandas_udf(_message_batch, MESSAGE)(packet)


def decoded_info(info: Column) -> Column:
    return F.pandas_udf(_info_batch, INFO)(info)


def decoded_text(value: Column) -> Column:
    return F.pandas_udf(_legacy_batch, "string")(value)


def bencode_length(value: Column) -> Column:
    return F.pandas_udf(_length_batch, "int")(value)


def packed_ipv4(ip: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    p = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(p, F.lit(i)).try_cast("bigint")
    shape = ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    return F.when(shape, number)


#: Networks that no public peer has: address and prefix length.
RESERVED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def reserved_ranges() -> list[tuple[int, int]]:
    out = []
    for ip, bits in RESERVED:
        low = int.from_bytes(bytes(map(int, ip.split("."))), "big")
        out.append((low, low + (1 << 32 - bits) - 1))
    return out


def is_public_peer(ip: Column, port: Column) -> Column:
    """A port of 1024 or more and an address outside the reserved networks."""
    n = packed_ipv4(ip)
    ok = (port >= 1024) & n.isNotNull()
    for low, high in reserved_ranges():
        ok = ok & ~n.between(low, high)
    return F.coalesce(ok, F.lit(False))


#: How a peer connection begins: the length of the protocol's name and the name.
PROTOCOL = b"\x13BitTorrent protocol"
#: Key under which each query method names what it asks for.
QUERY_KEYS = {"find_node": "6:target", "get_peers": "9:info_hash", "sample_infohashes": "6:target"}
_EXTENDED = 20
PEER_MESSAGE = "kind string, ut_metadata int, metadata_size bigint, msg_type int, piece bigint"


def handshake(packet: Column) -> Column:
    """struct(info_hash, extensions, peer_id) of the 68 bytes that open a connection, null if they are none."""
    ok = (F.octet_length(packet) >= 68) & (F.substring(packet, 1, 20) == F.lit(PROTOCOL))
    bit = F.conv(F.hex(F.substring(packet, 26, 1)), 16, 10).cast("int").bitwiseAND(0x10) != 0
    return F.when(ok, F.struct(F.lower(F.hex(F.substring(packet, 29, 20))).alias("info_hash"), bit.alias("extensions"), F.lower(F.hex(F.substring(packet, 49, 20))).alias("peer_id")))


def extended_message(number: int, body: Column) -> Column:
    """A framed extension message: four bytes of length, its kind, the extension's number and the body."""
    size = F.unhex(F.lpad(F.hex((F.octet_length(body) + 2).cast("bigint")), 8, "0"))
    return F.concat(size, F.lit(bytes([_EXTENDED, number])), body)


def query(method: str, txid: Column, own: Column, wanted: Column) -> Column:
    """A DHT query packet; ``txid`` has two bytes, ``own`` and ``wanted`` twenty."""
    head, middle = b"d1:ad2:id20:", f"{QUERY_KEYS[method]}20:".encode()
    return F.concat(F.lit(head), own, F.lit(middle), wanted, F.lit(f"e1:q{len(method)}:{method}1:t2:".encode()), txid, F.lit(b"1:y1:qe"))


def extension(packet: bytes | None) -> dict:
    """What an extension message says: an extended handshake (number 0) or a metadata message; kind 'other' for any other frame."""
    out = dict.fromkeys(("kind", "ut_metadata", "metadata_size", "msg_type", "piece"))
    if packet is None or len(packet) < 5 or int.from_bytes(packet[:4], "big") > len(packet) - 4:
        return out
    out["kind"] = "other"
    if packet[4] != _EXTENDED or len(packet) < 7:
        return out
    try:
        d, _ = bdecode(packet[6:])
    except Malformed:
        return out
    whole = lambda x: x if isinstance(x, int) else None
    if not isinstance(d, dict):
        return out
    if packet[5] == 0:
        known = d.get(b"m")
        number = whole(known.get(b"ut_metadata")) if isinstance(known, dict) else None
        if number is not None:
            out |= {"kind": "handshake", "ut_metadata": number & 0xFF, "metadata_size": whole(d.get(b"metadata_size")) or 0}
    elif whole(d.get(b"msg_type")) is not None and whole(d.get(b"piece")) is not None:
        out |= {"kind": "metadata", "msg_type": d[b"msg_type"], "piece": d[b"piece"]}
    return out


def _extension_batch(packets: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([extension(p) for p in packets], columns=["kind", "ut_metadata", "metadata_size", "msg_type", "piece"])
    return rows.astype({"ut_metadata": "Int32", "metadata_size": "Int64", "msg_type": "Int32", "piece": "Int64"})


def peer_message(packet: Column) -> Column:
    return F.pandas_udf(_extension_batch, PEER_MESSAGE)(packet)
