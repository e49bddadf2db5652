"""Secret scans: fixed patterns, and strings that a primed compressor can't foresee.

Three fixed patterns give the base spans.  Then every candidate string (a long
run of token characters with digits and letters, in a sensitive context: a word
such as token or password before it, on its line or the one above) is measured by its novelty: the
bytes it adds to a zstandard frame of the code around it, under a dictionary of
code and identifiers.  A candidate is a whole run, or what base spans leave of it;
long ones are measured in blocks, and one incompressible block reports them whole.
Private keys in PEM blocks are of the kind ``novel`` too.  Text that repeats its surroundings or common identifiers
adds few bytes; a random string adds nearly as many as it has information.
Candidates that stay incompressible are reported as spans of the kind ``novel``.

Defined results: a null or empty text has no spans.  Texts of any length are
scanned whole; the context of a candidate is a bounded window around it.
Repeated rows are scanned each by itself, alike; an empty table gives an empty result.
Spans that tie in their start stand in the order of their kinds, then by their end.
Columns of the caller that bear the names of the results give way to them.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added

KINDS = ("assign", "access", "hex", "novel")
_WORDS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = re.compile(_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MAYBE = re.compile(r"passw|secret|token|api_?key", re.ASCII)

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A word that names a secret, on the candidate's line or the line before.
_SENSITIVE = re.compile(
    r"(?:(?i:pass(?:word|wd|phrase)|secret|token|(?:api|access|private|encryption|signing)[\s_-]?key|[_-]key\b|credential|authorization|bearer|signature|client[\s_-]?id|conn(?:ection)?[\s_-]?string|(?:pass|auth)(?:_|\b))|[a-z]Key\b)"
    r"[\w-]{0,24}[^\n]{0,24}(?:\n[^\n]{0,24})?\Z"
)
#: The name in a run ``name=value``.
_NAME = re.compile(r"[A-Za-z_-][A-Za-z0-9_-]*=(?=[^=])")
#: A private key with its header; one without an end has its lines of base64 alone.
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{32,})+)")
CONTEXT = 200
LEAD = CONTEXT
#: Characters of a candidate measured at once; a shorter rest goes with the block before it.
BLOCK = 512
SHORTEST = 16
#: Marginal compressed bytes a character from which a string counts as incompressible.
NOVEL = 0.62
MIN_DIGITS = 2

#: What code, settings and prose around secrets look like; primes the compressor.
DICTIONARY = "\n".join(
    [
        "import os\nimport sys\nfrom typing import Any\ndef main() -> None:\n    return None\nclass Config:\n    def __init__(self, name: str):\n        self.name = name\n",
        "const config = { host: 'localhost', port: 8080, timeout: 30000, username: 'admin', password: process.env.PASSWORD };\nmodule.exports = config;\n",
        "aws_access_key_id = \naws_secret_access_key = \nAuthorization: Bearer \napi_key: \napikey=\ntoken = \"\"\nclient_secret: ''\nprivate_key_id\nAKIA\nghp_\nsk_live_\npk_test_\nxoxb-\n",
        "https://www.example.com/index.html?page=1&id=\nhttp://localhost:3000/api/v1/users\nuser@example.com\n",
        "0000000000000000 1111111111111111 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 2020-01-01T00:00:00Z deadbeef xxxxxxxxxxxxxxxx your-api-key-here changeme example placeholder\n",
        "public static final String getConnection setParameter createInstance initialize configuration application response request authentication authorization description implementation environment production development\n",
    ]
).encode()

_kept: dict[str, zstandard.ZstdCompressor] = {}


def _size(data: bytes) -> int:
    if "c" not in _kept:
        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _kept["c"] = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(_kept["c"].compress(data))


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that ``candidate`` adds to ``around``, for each of its characters."""
    base = around.encode("utf-8", "surrogatepass")
    return (_size(base + b"\n" + candidate.encode("utf-8", "surrogatepass")) - _size(base + b"\n")) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if _MAYBE.search(text.lower()):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def uncovered(a: int, b: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no span of ``taken``, sorted, meets, if they are long enough for a candidate."""
    parts = []
    for start, end, _ in taken:
        if start < b and a < end:
            parts.append((a, start))
            a = end
    return [(x, y) for x, y in [*parts, (a, b)] if y - x >= SHORTEST]


def incompressible(found: str, around: str) -> bool:
    """Whether a block of ``found`` adds as many bytes as random characters would."""
    last = max(1, len(found) // BLOCK) if len(found) % BLOCK < SHORTEST else -(-len(found) // BLOCK)
    bounds = [*range(0, last * BLOCK, BLOCK), len(found)]
    return any(novelty(found[x:y], around) >= NOVEL for x, y in zip(bounds, bounds[1:], strict=False))


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible candidates in sensitive contexts that no span of ``taken`` meets."""
    spans = [(m.start(), m.end(), "novel") for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else []
    taken = sorted(taken + spans)
    for m in _CANDIDATE.finditer(text):
        name = _NAME.match(m[0])
        start = m.start() + name.end() if name and _SENSITIVE.search(name[0]) else m.start()
        parts = uncovered(start, m.end(), taken)
        if not parts or not _SENSITIVE.search(text[max(0, m.start() - LEAD) : start]):
            continue
        around = text[max(0, m.start() - CONTEXT) : m.start()] + text[m.end() : m.end() + CONTEXT]
        for a, b in parts:
            found = text[a:b]
            if sum(x.isdigit() for x in found) < MIN_DIGITS or found.isdigit():
                continue
            if incompressible(found, around.replace(found, "")):  # a secret that is there twice is still one
                spans.append((a, b, "novel"))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``[secret]``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(id, columns of ``keep``, n_assign, n_access, n_hex, n_novel, base_sha256, spans[, redacted]) by row."""
    made = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "redacted"]
    kept = [c for c in keep if c not in ["id", *made]]

    def rows(texts: list[str | None]) -> list[list]:
        found = []
        for text in texts:
            base = base_spans(text or "")
            new = novel_spans(text or "", base)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            found.append((*n, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new), None if text is None or not with_text else redacted(text, base + new)))
        return [[x[i] for x in found] for i in range(6 + with_text)]

    schema = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string" + ", redacted string" * with_text
    return added(docs, [F.col(id_col).alias("id"), *kept], text_col, schema, rows)
