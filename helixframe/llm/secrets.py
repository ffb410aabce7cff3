"""Secret scans: base patterns, and novelty against a primed zstandard dictionary.

Novelty: a candidate string near a sensitive word is compressed together with the code around it, by a
compressor primed with common identifiers, and without it; the marginal bytes over its length tell how far
neither the surroundings nor the dictionary explain it.  Incompressible candidates are reported.  A candidate that
only dots, quotes or line breaks part from one in sensitive context is in that context too, so that all lines of
a key and all parts of a dotted token count.

Nulls count as empty texts, empty texts have no spans, and texts of any length are scanned whole.
Spans are kind:start:end in code points, the end exclusive; spans of one start are in the order of their kinds.
Scanning reads doc_id and text only, so names of other columns cannot clash; repeated rows give repeated, equal rows, and an
empty table gives an empty one.
"""

import hashlib
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, small_batches, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs that are long enough; a shorter run can't hold one
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate: so many characters, with a letter and a digit, this near behind a sensitive word.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = ("passw", "pwd", "secret", "token", "api_key", "apikey", "api-key", "bearer", "credential", "private", "signature", "session", "auth")
NEAR, AROUND = 48, 256
#: What may stand between the pieces of one string (with a dot, quote or line break in it), and the short last line of a key block.
_BETWEEN = r"""(?:\\[nr]|[\s."'`,\\>|#*])"""
JOINT, JOINS = re.compile(_BETWEEN + "++"), re.compile(r"""[."'`\\\r\n]""")
LAST_LINE = re.compile(f"{_BETWEEN}*+([A-Za-z0-9+/=]{{1,15}}?)(?={_BETWEEN}*+-----END)")
#: Marginal compressed bytes for each character from which a candidate is reported; random base64 has about 0.75.
NOVELTY = 0.6
#: Fixed words that the compressor knows beforehand; a parameter of the operator.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key private_key public_key secret_key session_id "
    "password username authorization authentication Bearer Basic credentials certificate signature configuration "
    "localhost example.com https://www. http:// .json .yaml .html /usr/local/bin /home/user/ environment variable "
    "import export return function class const static public private protected async await string integer boolean "
    "number object array value default null undefined true false self this request response header content-type "
    "application/json x-www-form-urlencoded charset=utf-8 user_agent connection database postgres mysql mongodb "
    "redis_url bucket region endpoint service account project version release build test production development "
    "placeholder changeme your_api_key_here XXXXXXXXXXXXXXXX 0000000000000000 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes for each character, under a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False).compress

    def __call__(self, before: str, candidate: str, after: str) -> float:
        code = (before + after).encode()
        whole = code + candidate.encode()
        return (len(self.compress(whole)) - len(self.compress(code))) / max(1, len(candidate))


def joined(text: str, a: int, b: int) -> bool:
    return JOINT.fullmatch(text, a, b) is not None and JOINS.search(text, a, b) is not None


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """Incompressible candidates in sensitive context, their own or carried on, that no base span overlaps."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found: list[tuple[int, int, int]] = []
    ends: list[tuple[int, int, bool]] = []  # base spans, merged; whether one of a secret is among them
    for a, kind, b in known:
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]), ends[-1][2] or kind < 2)
        else:
            ends.append((a, b, kind < 2))
    k, last = 0, None  # last: the end of the piece before, if in sensitive context
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        s = m[0]
        before = text[max(0, a - AROUND) : a]
        sensitive = any(w in before[-NEAR:].lower() for w in SENSITIVE) or last is not None and joined(text, last, a)
        if k < len(ends) and ends[k][0] < b:
            last = max(b, ends[k][1]) if sensitive or ends[k][2] else None
            continue
        last = b if sensitive else None
        if sensitive and any(map(str.isdigit, s)) and any(map(str.isalpha, s)) and novelty(before, s, text[b : b + AROUND]) >= least:
            found.append((a, 3, b))
            short = LAST_LINE.match(text, b)
            if short:
                found.append((short.start(1), 3, short.end(1)))
    return found


def scan(docs: DataFrame, novelty: float = NOVELTY, identifiers: str = IDENTIFIERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of each document.

    docs: doc_id, text; other columns are not read.  Each document is scanned where it is read.
    """
    small_batches(docs.sparkSession)

    def rows(batch: dict) -> dict:
        measure = Novelty(identifiers)
        out: dict[str, list] = {"doc_id": batch["doc_id"]} | {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for value in batch["text"]:
            text = value.as_py() or ""
            base = base_spans(text)
            spans = sorted(base + novel_spans(text, base, measure, novelty))
            told = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x[1] == i for x in spans))
            out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            out["spans"].append(told(spans))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", novelty: float = NOVELTY) -> DataFrame:
    """docs with every span in `text` replaced by a mark and n_chars, if there, counted anew; null texts stay null.

    Other columns stay as they are.
    """
    small_batches(docs.sparkSession)

    def clean(texts: pd.Series) -> pd.Series:
        measure, out = Novelty(), []
        for text in texts:
            if not isinstance(text, str):
                out.append(None)
                continue
            base = base_spans(text)
            parts, at = [], 0
            for a, _, b in sorted(base + novel_spans(text, base, measure, novelty)):
                if b <= at:
                    continue
                parts += [text[at:a], mark] if a >= at else []  # an overlapping span goes with the one before it
                at = b
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", F.pandas_udf(clean, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
