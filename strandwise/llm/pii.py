"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import free, lean, stage, table

#: Kinds with a fixed definition, in order; their matches always count.
BASE = ("email", "ip", "card", "phone")
#: Kinds that only the classifier decides on.
ADDED = ("email_words", "phone_local", "secret")
KINDS = BASE + ADDED

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]++\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,}+")
PHONE_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
#: A body of any length: parts joined by dots, one of 16 characters or more, and padding. What is left of "=" in name=value is none.
SECRET = re.compile(r"(?<=[=:])\s{0,3}[\"']?(?=[A-Za-z0-9+/_.-]*?[A-Za-z0-9+/_-]{16})([A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+(?:=++(?![A-Za-z0-9+/_-]))?+)(?!=)")

ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co us ch at nl it".split())
CUES = {
    "email": "mail email e-mail contact write reach", "ip": "ip address host server login client", "card": "card visa mastercard amex credit payment pay",
    "phone": "phone tel call fax mobile cell contact", "email_words": "mail email e-mail contact write reach", "phone_local": "phone tel call fax mobile cell contact",
    "secret": "token key secret password passwd pwd apikey api_key auth credential bearer",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version isbn issn doi order invoice page figure fig table price chapter section sha md5 checksum build".split())
CUE = re.compile(r"[A-Za-z_-]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        part = text[end:at]
        start = end + len(part.rstrip(LOCAL))
        end = max(end, at + 1)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", end)
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the four fixed kinds, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def added_candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the added kinds that overlap no fixed span and no earlier candidate."""
    found = []
    if "dot" in text:
        found += [(4, *m.span()) for m in EMAIL_WORDS.finditer(text)]
    found += [(5, *m.span()) for m in PHONE_LOCAL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(6, *m.span(1)) for m in SECRET.finditer(text)]
    if not found:
        return found
    busy = sorted((s, e) for _, s, e in taken)
    out = []
    for kind, s, e in found:
        if not any(s < y and x < e for x, y in busy):
            out.append((kind, s, e))
            busy.append((s, e))
    return out


def votes(text: str, kind: int, s: int, e: int) -> tuple[int, int, int, int]:
    """What four labelers say: 2 personal, 0 not, 1 abstain. Form (regex), gazetteer, context, surroundings."""
    name, body = KINDS[kind], text[s:e]
    before = [w.lower() for w in CUE.findall(text[max(0, s - 40) : s])]
    digits = "".join(filter(str.isdigit, body))
    if name in ("email", "email_words"):
        ending = re.split(r"[.\s\])]+", body)[-1].lower()
        form, known = 2, 2 if ending in ENDINGS else 1
    elif name == "ip":
        parts = body.split(".")
        form, known = (2 if all(p == "0" or p[0] != "0" for p in parts) else 0), (0 if parts[0] == "0" else 1)
    elif name == "card":
        form, known = 2, 2 if digits[0] in "3456" else 1
    elif name in ("phone", "phone_local"):
        form = 2 if len(set(digits)) > 2 else 0
        known = 2 if name == "phone" or digits[0] not in "01" else 1
    else:
        mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body) and len(set(body)) >= 8
        form, known = (2 if mixed else 0), (2 if before[-1:] and any(c in before[-1] for c in CUES["secret"]) else 0)
    context = 0 if AGAINST & set(before[-3:]) else 2 if CUES[name] & set(before[-4:]) else 1
    left, right = text[s - 1 : s], text[e : e + 1]
    glued = (left.isalnum() and name != "email") or right.isalnum()
    around = 0 if glued else 2 if (not left or left.isspace() or left in "\"'(<[=:,;") and (not right or right.isspace() or right in "\"')>],.;:!?") else 1
    return form, known, context, around


def features(text: str, kind: int, s: int, e: int) -> int:
    """Kind, votes, a length class and whether the span stands on its own line, as one small integer (below 7 * 81 * 8)."""
    f, k, c, a = votes(text, kind, s, e)
    size = min(3, (e - s) // 12)
    alone = int(text[s - 1 : s] in ("", "\n") or text[e : e + 1] in ("", "\n"))
    return ((kind * 81 + f * 27 + k * 9 + c * 3 + a) * 4 + size) * 2 + alone


SPANS = "array<struct<kind:int,start:long,end:long,pattern:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, found and spans, then found: all candidate spans of the whole text with their patterns."""
    others = [c for c in docs.columns if c not in ("text", "found", "spans")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(len(others)):
                text = value.as_py() or ""
                spans = base_spans(text)
                spans += added_candidates(text, spans)
                out.append([{"kind": k, "start": s, "end": e, "pattern": features(text, k, s, e)} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(out, kind)], [*others, "found"])

    return docs.select(*others, "text").mapInArrow(lean("pii", run), f"{fields}, found {SPANS}")


def unpacked(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes with four columns, the other two features) of pattern integers."""
    code, rest = pattern // 8, pattern % 8
    ballots = np.stack([code // 27 % 3, code // 9 % 3, code // 3 % 3, code % 3], 1)
    return code // 81, ballots, np.stack([rest // 2, rest % 2], 1)


def reliabilities(kind: np.ndarray, ballots: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(personal) for every pattern by expectation-maximisation over counted patterns.

    Each labeler has a distribution of its votes given the truth, shared by all kinds, and each kind
    a share of true spans. The start is the votes' mean; pseudo-counts keep rare votes apart.
    """
    p = np.clip(ballots.mean(1) / 2, 0.05, 0.95)
    for _ in range(rounds):
        log_odds = np.zeros(len(p))
        for k in np.unique(kind):
            own = kind == k
            share = (np.sum(p[own] * count[own]) + 3) / (np.sum(count[own]) + 4)
            log_odds[own] = np.log(share / (1 - share))
        for j in range(ballots.shape[1]):
            true = np.bincount(ballots[:, j], p * count, 3) + np.array([0.5, 2, 4])
            false = np.bincount(ballots[:, j], (1 - p) * count, 3) + np.array([4, 2, 0.5])
            log_odds += np.log(true / true.sum() / (false / false.sum()))[ballots[:, j]]
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return p


def classifier(pattern: np.ndarray, count: np.ndarray, steps: int = 400) -> np.ndarray:
    """P(personal) for every pattern from a logistic regression on one-hot features, taught by EM's soft labels."""
    kind, ballots, rest = unpacked(pattern)
    soft = reliabilities(kind, ballots, count)
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[ballots[:, j]] for j in range(4)), np.eye(4)[rest[:, 0]], rest[:, 1:]], 1)
    weight = count / count.sum()
    w, fast = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        ahead = w - 0.9 * fast
        slope = x.T @ (weight * (1 / (1 + np.exp(-x @ ahead)) - soft)) + 1e-4 * ahead
        fast = 0.9 * fast + slope
        w = w - fast
    return 1 / (1 + np.exp(-x @ w))


def accepted(found: DataFrame, threshold: float = 0.5) -> list[int]:
    """The patterns whose spans count, learned from the counts of all patterns in all documents (at most a few thousand)."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.pattern").count().collect()
    if not rows:
        return []
    pattern, count = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    order = np.argsort(pattern)
    pattern, count = pattern[order], count[order]
    p = classifier(pattern, count)
    return [int(x) for x, y in zip(pattern, p) if y >= threshold or x // 648 < len(BASE)]


def detect(docs: DataFrame) -> DataFrame:
    """docs without text plus spans: array of (kind index, start, end, pattern), by kind and start.

    Offsets are code points, ends exclusive. Null text is empty; repeated rows are rows of their own;
    an empty table gives none. Matches of the fixed kinds all stay;
    spans of the added kinds stay if the classifier gives them one half or more.
    """
    found = stage(candidates(docs), "candidates")
    keep = accepted(found)
    good = F.filter("found", lambda s: (s["kind"] < len(BASE)) | (s["pattern"].isin(keep) if keep else F.lit(False)))
    return found.withColumn("spans", F.array_sort(good)).drop("found")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets, and n_chars as it is then.

    Texts are searched once: the rows are staged with their candidates, which teach the classifier
    and are then replaced where it accepts them. Spans that overlap an earlier one go with it. Null
    texts stay null, repeated rows are treated alike, and columns of any name stay as they are.
    """
    columns = docs.columns
    spans, body, found_as = free("_spans", columns), docs.columns.index("text"), free("_row", columns)
    fields = docs.schema.fields
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(found_as), "text")
    found = stage(candidates(whole), "candidates")
    keep = accepted(found)
    good = F.filter("found", lambda s: (s["kind"] < len(BASE)) | (s["pattern"].isin(keep) if keep else F.lit(False)))
    ordered = F.array_sort(F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = found.select(*(F.col(f"`{found_as}`.`{c}`").alias(c) for c in columns), ordered.alias(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, marked in zip(batch.column(body), batch.column(len(columns)).to_pylist()):
                text, end, parts = value.as_py(), 0, []
                for span in marked:
                    s, e = span["start"], span["end"]
                    if e > end:
                        parts += [text[end:s], f"<{KINDS[span['kind']]}>"] if s >= end else []
                        end = e
                out.append("".join([*parts, text[end:]]) if marked else text)
            kept = list(batch.columns[:-1])
            kept[body] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(kept, columns)

    redacted = rows.mapInArrow(lean("pii", run), StructType(fields))
    return redacted.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of documents.

    Null and empty texts have no spans. Very long texts, and secrets of any length, are searched whole.
    Repeated rows and null doc_ids are rows of their own; an added span never overlaps another. An
    empty table gives no rows. Other columns aren't read.
    """
    spans = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return spans.select("doc_id", *(count(k) for k in range(4)), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
