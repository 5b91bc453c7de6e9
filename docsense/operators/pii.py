"""Personal data with spans: kinds with confidences, overlap removal, redaction, and recursive filtering of JSON."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.operators.batches import found_rows

#: Patterns of the kinds of personal data.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "aws_key": r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}",
    "api_key": r"""(?:api[_-]?key|apikey|api_token)[\s]*[:=][\s]*["']?([a-zA-Z0-9_\-]{20,})["']?""",
    "jwt_token": r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*",
    "password": r"""(?:password|passwd|pwd)[\s]*[:=][\s]*["']?([^\s"']{8,})["']?""",
    "bank_account": r"\b[0-9]{8,17}\b",
    "driver_license": r"\b[A-Z]{1,2}[0-9]{5,8}\b",
}
NAME = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+ [A-Z][a-z]+"
ADDRESS = r"(?i)\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b"
#: Kinds that are looked for unless others are named, and the least confidence.
DEFAULT = ("email", "phone", "ssn", "credit_card", "ip_address", "aws_key", "api_key", "jwt_token", "password")
LEAST = 0.8
FOUND = "array<struct<kind:string,start:int,end:int,confidence:double>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def confidence(kind: str, value: str) -> float:
    if kind == "credit_card":
        return 0.95 if _luhn(re.sub(r"\D", "", value)) else 0.6
    if kind == "email":
        return 0.95 if "." in value.partition("@")[2] else 0.7
    if kind == "ssn":
        return 0.9 if len(re.sub(r"[- ]", "", value)) == 9 else 0.5
    return 0.9


def detect(text: str | None, kinds=DEFAULT, custom: dict[str, str] | None = None, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) without overlaps: the leftmost stays, of equal starts the surest.

    Custom patterns keep their own names. Names and addresses are found whatever the least confidence.
    """
    text, found = text or "", []
    patterns = {k: PATTERNS[k] for k in kinds} | (custom or {})
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text, 0 if kind == "aws_key" else re.IGNORECASE):
            sure = confidence(kind, m[0])
            if sure >= least:
                found.append((kind, *m.span(), sure))
    found += [("person_name", *m.span(), 0.85) for m in re.finditer(NAME, text)]
    found += [("address", *m.span(), 0.75) for m in re.finditer(ADDRESS, text)]
    out, end = [], -1
    for one in sorted(found, key=lambda x: (x[1], -x[3])):
        if one[1] >= end:
            out.append(one)
            end = one[2]
    return out


def redact(text: str | None, found, how: str = "mask") -> str:
    """Spans masked by blocks of their length, replaced by kind and digest (``hash``), or by kind alone (``tag``)."""
    text = text or ""
    for kind, start, end, _ in sorted(found, key=lambda x: -x[1]):
        new = {"mask": "█" * (end - start), "hash": f"[{kind}:{hashlib.sha256(text[start:end].encode()).hexdigest()[:8]}]", "tag": f"[{kind}]"}[how]
        text = text[:start] + new + text[end:]
    return text


def spans(text: Column, kinds=DEFAULT, custom: dict[str, str] | None = None) -> Column:
    names = ("kind", "start", "end", "confidence")

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, f)) for f in detect(t.as_py(), kinds, custom)] for t in texts], _FOUND)

    return of(text)


def span_rows(rows: DataFrame, keys: list[str], text: str, kinds=DEFAULT, custom: dict[str, str] | None = None) -> DataFrame:
    """The keys with kind, start, end and confidence, a row for every finding."""
    return found_rows(rows, keys, [F.col(text)], "kind string, start int, end int, confidence double", lambda t: detect(t, kinds, custom))


def redacted(text: Column, how: str = "mask", kinds=DEFAULT) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t, detect(t, kinds), how) for t in (x.as_py() for x in texts)], pa.string())

    return of(F.coalesce(text, F.lit("")))


def filtered(value, how: str = "mask"):
    """A JSON value with its texts and keys redacted, and findings by path (a.b, a[0], key:k)."""
    found: dict[str, list] = {}

    def clean(text: str, path: str) -> str:
        hits = detect(text)
        if hits:
            found[path] = hits
        return redact(text, hits, how)

    def walk(x, path: str):
        if isinstance(x, str):
            return clean(x, path)
        if isinstance(x, list):
            return [walk(y, f"{path}[{i}]") if isinstance(y, (str, dict)) else y for i, y in enumerate(x)]
        if isinstance(x, dict):
            join = lambda k: f"{path}.{k}" if path else k
            return {clean(k, join(f"key:{k}")): walk(v, join(k)) for k, v in x.items()}
        return x

    return walk(value, ""), found


def filtered_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, clean (the JSON redacted), and paths (where something was found, sorted); null for what isn't JSON."""

    @F.pandas_udf("struct<clean:string,paths:array<string>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                clean, found = filtered(json.loads(t))
                out.append((json.dumps(clean, ensure_ascii=False), sorted(found)))
            except (TypeError, ValueError, RecursionError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["clean", "paths"])

    return rows.select(key, of(F.col(text)).alias("r")).select(key, "r.*")


def json_limits(rows: DataFrame, key: str, text: str, depth: int = 10, keys: int = 1000, length: int = 10_000) -> DataFrame:
    """key, depth, keys, longest and whether a JSON value keeps within limits of nesting, keys and text length.

    What isn't JSON, null or nested beyond what a parser takes has null measures and isn't accepted.
    """

    def measure(x, level: int = 0) -> tuple[int, int, int]:
        if isinstance(x, str):
            return level, 0, len(x)
        parts = [measure(y, level + 1) for y in (x.values() if isinstance(x, dict) else x)] if isinstance(x, (dict, list)) else []
        own = len(x) if isinstance(x, dict) else 0
        return max([level, *(p[0] for p in parts)]), own + sum(p[1] for p in parts), max([0, *(p[2] for p in parts)])

    @F.pandas_udf("struct<depth:int,keys:int,longest:int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(measure(json.loads(t)))
            except (TypeError, ValueError, RecursionError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["depth", "keys", "longest"]).astype("Int32")

    ok = (F.col("m.depth") <= depth) & (F.col("m.keys") <= keys) & (F.col("m.longest") <= length)
    return rows.select(key, of(F.col(text)).alias("m")).select(key, "m.*", F.coalesce(ok, F.lit(False)).alias("accepted"))
