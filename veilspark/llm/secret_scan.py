"""Operator 13: secrets, confirmed by their structure.

Three base kinds are found by their fixed patterns. Beyond them, runs that look like encoded bytes are candidates only:
base64 (both alphabets, armoured over lines too) and hex are decoded, and a span is reported if what comes out is what
it has to be - nested lengths of a key encoding that add up, the packets of an armoured key, a token's header and
claims with a signature as long as its algorithm makes it, a checksum.

Kinds, in order: assign, access, hex (base), then
  pem      an armoured private key whose body decodes to the key that its label names (or to whole cipher blocks, if it is encrypted)
  der      a private key in base64 or hex without armour
  ssh      an OpenSSH private key without armour
  pgp      an armoured PGP private key: packet lengths that fill the body, a secret-key packet first
  jwt      a signed token (three parts) or an encrypted one (five parts)
  fernet   a Fernet token
  basic    credentials of an Authorization header
  github   a token whose last six characters are the checksum of the others

Work is a projection over the scan, in Arrow batches of bounded size, linear in the text: each candidate is decoded once.

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty table gives no rows;
columns other than doc_id and text are ignored (and kept by redact()).
"""

from __future__ import annotations

import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.words import slices

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "pgp", "jwt", "fernet", "basic", "github")
RANK = {k: i for i, k in enumerate(KINDS)}
N_BASE = 3
Span = tuple[int, int, str, str]  # start, end, kind, what the structure says

# The base patterns, and what each encoding prescribes.
ASSIGN = re.compile(r"(?ia:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6
LARGEST = 32_768  # bits of a key's modulus
OPENSSH = b"openssh-key-v1\0"
ALGORITHMS = {
    "1.2.840.113549.1.1.1": "rsa", "1.2.840.113549.1.1.10": "rsa-pss", "1.2.840.10040.4.1": "dsa", "1.2.840.113549.1.3.1": "dh", "1.2.840.10045.2.1": "ec", "1.3.101.110": "x25519", "1.3.101.111": "x448",
    "1.3.101.112": "ed25519", "1.3.101.113": "ed448", "1.2.840.113549.1.5.13": "pbes2", "1.2.840.113549.1.12.1.3": "pbe-3des",
}
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "ES256K": (64, 64), "EdDSA": (64, 114), "none": (0, 0)} | {a + s: (128, 1024) for a in ("RS", "PS") for s in ("256", "384", "512")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){32,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){32,}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_-])")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY(?: BLOCK)?)-----")
BASIC = re.compile(r"(?ia:(?<![A-Za-z0-9])basic) ([A-Za-z0-9+/]{4,}={0,2})(?![A-Za-z0-9+/=])")
GITHUB = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY_TYPE = re.compile(rb"[a-z0-9@.-]+")
SPACE = re.compile(r"\s+")
BASE64 = re.compile(r"[A-Za-z0-9+/]*={0,2}")


def base64_bytes(text: str) -> bytes | None:
    """What base64 in either alphabet holds; nothing if it cannot be whole or its last bits are not zero."""
    text = text.replace("-", "+").replace("_", "/")
    bare = text.rstrip("=")
    if len(bare) % 4 == 1 or not BASE64.fullmatch(text):
        return None
    data = binascii.a2b_base64(bare + "=" * (-len(bare) % 4))
    return data if binascii.b2a_base64(data, newline=False).rstrip(b"=").decode() == bare else None


class Broken(ValueError):
    """The bytes are not what was looked for."""


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(tag, first, last) of the DER element at `at`; its length must be the shortest form and end within `end`."""
    if at + 2 > end:
        raise Broken
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            raise Broken
        size = int.from_bytes(data[at : at + k], "big")
        if size < (0x80 if k == 1 else 1 << (8 * (k - 1))):
            raise Broken
        at += k
    if at + size > end:
        raise Broken
    return tag, at, at + size


def children(data: bytes, first: int, last: int) -> list[tuple[int, int, int]]:
    out = []
    while first < last:
        out.append(tlv(data, first, last))
        first = out[-1][2]
    return out


def object_id(data: bytes) -> str:
    parts, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    if value or not parts:
        raise Broken
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def rsa_key(data: bytes) -> str:
    """An RSAPrivateKey: 0, n, e, d, p, q and three numbers more, in which n is p times q."""
    tag, first, last = tlv(data, 0, len(data))
    parts = children(data, first, last)
    if tag != 0x30 or last != len(data) or [p[0] for p in parts] != [0x02] * 9:
        raise Broken
    n, p, q = (int.from_bytes(data[parts[i][1] : parts[i][2]], "big") for i in (1, 4, 5))
    if not 256 <= n.bit_length() <= LARGEST or p.bit_length() + q.bit_length() > LARGEST + 1 or p * q != n:
        raise Broken
    return f"rsa-{n.bit_length()}"


def private_key(data: bytes) -> str:
    """The kind of private key that DER bytes are, all of them; Broken if they are none."""
    tag, first, last = tlv(data, 0, len(data))
    if tag != 0x30 or last != len(data):
        raise Broken
    parts = children(data, first, last)
    tags = [p[0] for p in parts]
    whole = lambda p: int.from_bytes(data[p[1] : p[2]], "big")
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # EncryptedPrivateKeyInfo
        scheme = children(data, *parts[0][1:])
        if not scheme or scheme[0][0] != 0x06 or parts[1][2] - parts[1][1] < 8:
            raise Broken
        return f"encrypted-{ALGORITHMS.get(object_id(data[scheme[0][1] : scheme[0][2]]), 'pbe')}"
    if not tags or tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        raise Broken
    version = whole(parts[0])
    if version == 0 and len(tags) == 9 and set(tags) == {0x02}:
        return rsa_key(data)
    if version == 0 and len(tags) == 6 and set(tags) == {0x02}:  # DSA: p, q, g, y, x
        p, q, g, y, x = map(whole, parts[1:])
        if not q or not 512 <= p.bit_length() <= LARGEST or (p - 1) % q or not 0 < x < q:
            raise Broken
        return f"dsa-{p.bit_length()}"
    if version == 1 and tags[1:2] == [0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # ECPrivateKey
        size = parts[1][2] - parts[1][1]
        if size not in (20, 24, 28, 29, 30, 32, 40, 48, 64, 66) or not tags[2:]:
            raise Broken
        for p in parts[2:]:
            children(data, *p[1:])
        return f"ec-{8 * size}"
    if version in (0, 1) and tags[1:3] == [0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:  # PrivateKeyInfo
        scheme = children(data, *parts[1][1:])
        if not scheme or scheme[0][0] != 0x06:
            raise Broken
        name = ALGORITHMS.get(object_id(data[scheme[0][1] : scheme[0][2]]))
        inner = data[parts[2][1] : parts[2][2]]
        if name is None:
            raise Broken
        if name in ("rsa", "rsa-pss"):
            return rsa_key(inner)
        kind, a, b = tlv(inner, 0, len(inner))
        if b != len(inner) or kind != {"ec": 0x30, "dsa": 0x02, "dh": 0x02}.get(name, 0x04):
            raise Broken
        if name == "ec":
            own = children(inner, a, b)
            if len(own) < 2 or [o[0] for o in own[:2]] != [0x02, 0x04]:
                raise Broken
        return name
    raise Broken


def lengths(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    """n strings that each follow their own length, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise Broken
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def openssh_key(data: bytes) -> str:
    """The kind of OpenSSH private key: cipher, kdf, options, number of keys, public keys, private part."""
    if not data.startswith(OPENSSH):
        raise Broken
    (cipher, kdf, _), at = lengths(data, len(OPENSSH), 3)
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= 64:
        raise Broken
    public, at = lengths(data, at + 4, n)
    (private,), at = lengths(data, at, 1)
    (kind,), _ = lengths(public[0], 0, 1)
    if not KEY_TYPE.fullmatch(kind) or not private or len(private) % 8 or (kdf == b"none") != (cipher == b"none") or at != len(data) and cipher == b"none":
        raise Broken
    if cipher == b"none" and private[:4] != private[4:8]:  # the check number stands there twice
        raise Broken
    return ("" if cipher == b"none" else "encrypted-") + kind.decode()


def pgp_key(data: bytes) -> str:
    """A secret-key packet, and packets behind it whose lengths fill all bytes."""
    at, kinds = 0, []
    while at < len(data):
        head = data[at]
        if not head & 0x80:
            raise Broken
        at += 1
        if head & 0x40:
            tag, first = head & 0x3F, data[at] if at < len(data) else 255
            if first < 192:
                size, at = first, at + 1
            elif first < 224:
                size, at = (first - 192 << 8) + (data[at + 1] if at + 1 < len(data) else 0) + 192, at + 2
            elif first == 255:
                size, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                raise Broken
        else:
            tag, k = head >> 2 & 15, 1 << (head & 3)
            if k == 8:
                raise Broken
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        at += size
        kinds.append(tag)
    if at != len(data) or kinds[:1] != [5]:
        raise Broken
    return f"packets-{len(kinds)}"


def crc24(data: bytes) -> int:
    crc = 0xB704CE
    for b in data:
        crc ^= b << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def armoured(label: str, body: str) -> tuple[str, str]:
    """(kind, structure) of what stands between the lines of an armour."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace('"', "").replace("'", "")
    head, data, encrypted = [], [], False
    for line in map(str.strip, body.split("\n")):
        if ": " in line:
            encrypted |= line.startswith("DEK-Info") or "ENCRYPTED" in line
            head.append(line)
        elif line:
            data.append(line)
    if label.endswith("BLOCK"):
        check = data.pop() if data and data[-1].startswith("=") and len(data[-1]) == 5 else None
        raw = base64_bytes("".join(data))
        if not raw or check and base64_bytes(check[1:]) != crc24(raw).to_bytes(3, "big"):
            raise Broken
        return "pgp", pgp_key(raw)
    raw = base64_bytes(SPACE.sub("", "".join(data)))
    if not raw:
        raise Broken
    if label == "OPENSSH PRIVATE KEY":
        return "pem", openssh_key(raw)
    if encrypted:
        if len(raw) % 8 or len(raw) < 64:
            raise Broken
        return "pem", "encrypted-legacy"
    found = private_key(raw)
    named = {"RSA": "rsa", "EC": "ec", "DSA": "dsa", "ENCRYPTED": "encrypted"}.get(label.removesuffix("PRIVATE KEY").strip(), "")
    if not found.startswith(named):
        raise Broken
    return "pem", found


def signed_token(text: str) -> str:
    """The algorithm of a token, if its header is JSON that names one, and the other parts agree with it."""
    parts = text.split(".")
    try:
        header = json.loads(base64_bytes(parts[0]) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            raise Broken
        raw = [base64_bytes(p) for p in parts[1:]]
        if None in raw:
            raise Broken
        if len(parts) == 3:
            if not isinstance(json.loads(raw[0]), dict):
                raise Broken
            low, high = SIGNATURES.get(header["alg"], (16, 1024))
            if not low <= len(raw[1]) <= high:
                raise Broken
            return header["alg"] if header["alg"] in SIGNATURES else "other"
        if len(parts) == 5 and isinstance(header.get("enc"), str) and raw[2] and len(raw[3]) in (16, 24, 32):
            return "encrypted"
    except (ValueError, RecursionError) as e:
        raise Broken from e
    raise Broken


def fernet(data: bytes) -> bool:
    """Version, a time from 2010 to 2100, an initial vector, whole cipher blocks and a digest."""
    return len(data) >= 73 and data[0] == 0x80 and (len(data) - 57) % 16 == 0 and 1_262_304_000 <= int.from_bytes(data[1:9], "big") <= 4_102_444_800


def credentials(text: str) -> bool:
    raw = base64_bytes(text)
    try:
        user, colon, secret = (raw or b"").decode().partition(":")
    except UnicodeDecodeError:
        return False
    return bool(colon and user and secret) and (user + secret).isprintable()


def checksum(text: str) -> str:
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def bare(data: bytes | None) -> tuple[str, str] | None:
    """(kind, structure) of decoded bytes that stand alone."""
    if data is None:
        return None
    try:
        if data[:1] == b"\x30":
            return "der", private_key(data)
        if data.startswith(OPENSSH):
            return "ssh", openssh_key(data)
    except Broken:
        return None
    return ("fernet", "v128") if data[:1] == b"\x80" and fernet(data) else None


def find(text: str) -> list[Span]:
    """All spans (start, end, kind, structure) in code points, by start, then kind as listed, then end."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", "") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]
    within: list[tuple[int, int]] = []  # armoured bodies: their lines are no candidates of their own
    for m in ARMOUR.finditer(text) if "PRIVATE KEY" in text else ():
        closing, following = f"-----END {m[1]}-----", text.find("-----BEGIN ", m.end())
        end = text.find(closing, m.end(), following if following >= 0 else len(text))
        if end < 0:
            continue
        try:
            kind, structure = armoured(m[1], text[m.end() : end])
        except Broken:
            continue
        within.append((m.start(), end + len(closing)))
        out.append((*within[-1], kind, structure))
    k = 0
    for m in RUN.finditer(text):
        while k < len(within) and within[k][1] <= m.start():
            k += 1
        if not (k < len(within) and within[k][0] <= m.start()) and (m[0][:1] in "Mbg" and (found := bare(base64_bytes(m[0])))):
            out.append((m.start(), m.end(), *found))
    for m in HEX_RUN.finditer(text):
        if m[0][:2] in ("30", "6f", "6F", "80") and (found := bare(bytes.fromhex(m[0]))):
            out.append((m.start(), m.end(), *found))
    for m in TOKEN.finditer(text) if "eyJ" in text else ():
        try:
            out.append((m.start(), m.end(), "jwt", signed_token(m[0])))
        except Broken:
            continue
    if "asic " in text or "ASIC " in text:
        out += [(m.start(1), m.end(1), "basic", "user:password") for m in BASIC.finditer(text) if credentials(m[1])]
    if "gh" in text:
        out += [(m.start(), m.end(), "github", "crc32") for m in GITHUB.finditer(text) if checksum(m[1]) == m[2]]
    out.sort(key=lambda s: (s[0], RANK[s[2]], s[1]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, structures string, n_confirmed long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]
    names = [x.split(" ")[0] for x in REPORT.split(", ")]
    for batch in slices(batches):
        rows = []
        for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = find(t or "")
            base = [s for s in spans if RANK[s[2]] < N_BASE]
            n = [sum(s[2] == k for s in base) for k in KINDS[:N_BASE]]
            structures = ",".join(f"{k}:{s}" for _, _, k, s in spans if s)
            rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), structures, len(spans) - len(base)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: counts and digest of the base kinds, all spans, and what the confirmed ones hold."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_report, REPORT)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the first one's kind, as in [PEM]."""
    out, at = [], 0
    for a, b, k, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind; n_chars, where there is one, follows."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [None if t is None else redacted(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if n is None else len(n) for o, n in zip(old, new, strict=True)], columns[length].type)
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
