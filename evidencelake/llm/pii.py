"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

Matches of the fixed patterns are seeds, and so are long hexadecimal keys, which no fixed pattern of the result
covers. The words around a seed are lexical patterns, and every identifier-like token (six signs or more, one of them
a digit) that stands in such a pattern is an instance. Spark scores the graph of patterns and instances in turn: a
pattern's confidence is the share of its occurrences that are of trusted instances, an instance's trust that of its
patterns together; a pattern counts once enough different trusted instances stand in it, whether they were seeds or
were revealed by other patterns. What is trusted stays so, and rounds go on until nothing is added. Confident
patterns reveal the trusted instances in them; those get spans of the kind `context`.

Defined results: a null text is an empty one without spans; equal rows give equal rows; a null doc_id is kept; an
empty table gives no row; repeated rows count as often as they occur; further columns are ignored (by `redact` kept).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGES = "\"'`.,;:!?()[]{}<>"
#: Hexadecimal keys that seed contexts; they are reported only where their context is trusted.
KEY = re.compile(r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}\Z")
#: Different trusted instances that a pattern needs, confidence that pattern and instance need.
SUPPORT, CONFIDENT = 3, 0.6
CONTEXT = "context"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns by kind, then start; start and end in code points."""
    spans = [("email", a, b) for a, b in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _word(token: str) -> str:
    return re.sub("[0-9]+", "0", token.strip(EDGES).lower() or token)


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens with the patterns of the words around them."""
    taken = sorted((a, b) for _, a, b in spans)
    merged: list[tuple[int, int, bool]] = []
    for a, b in taken:
        if not merged or a >= merged[-1][1]:
            merged.append((a, b, True))
    items, at = [], 0
    tokens = [m.span() for m in TOKEN.finditer(text)]
    for a, b in tokens:
        while at < len(merged) and merged[at][1] <= a:
            items.append(merged[at])
            at += 1
        if at < len(merged) and merged[at][0] < b:
            continue  # part of a seed
        items.append((a, b, False))
    items += merged[at:]
    words = [None if seed else text[a:b] for a, b, seed in items]
    out = []
    for i, (a, b, seed) in enumerate(items):
        known = seed
        if not seed:
            token = words[i]
            if len(token) < 6 or not any("0" <= c <= "9" for c in token):
                continue
            inner = token.strip(EDGES)
            if len(inner) < 6 or not any("0" <= c <= "9" for c in inner):
                continue
            a += token.index(inner)
            b = a + len(inner)
            known = KEY.match(inner) is not None
        near = ["<" if i < n else ("@" if words[i - n] is None else _word(words[i - n])) for n in (2, 1)]
        after = ">" if i + 1 == len(items) else ("@" if words[i + 1] is None else _word(words[i + 1]))
        patterns = [_digest("\t".join(("before", *near))), _digest("\t".join(("around", near[1], after)))]
        out.append({"start": a, "end": b, "seed": known, "base": seed, "instance": _digest(text[a:b]), "patterns": patterns})
    return out


MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("base", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _key() -> tuple:
    text = F.coalesce("text", F.lit(""))
    return F.col("doc_id").cast("long"), F.unhex(F.md5(text)), text


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: its base spans, counted and joined, and its mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            some = pc.match_substring_regex(batch["text"], "[0-9@+]").to_pylist()
            counts, base, shas, found = [], [], [], []
            for text, has in zip(batch["text"].to_pylist(), some, strict=True):
                spans = base_spans(text) if has else []
                counts.append([sum(k == kind for k, *_ in spans) for kind in KINDS])
                base.append(joined(spans))
                shas.append(hashlib.sha256(base[-1].encode()).hexdigest())
                found.append(mentions(text, spans) if has else [])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["version"], *numbers, pa.array(shas), pa.array(base, pa.string()), pa.array(found, pa.list_(MENTION))],
                ["doc_id", "version", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mentions"],
            )

    mention = "array<struct<start: int, end: int, seed: boolean, base: boolean, instance: bigint, patterns: array<bigint>>>"
    schema = f"doc_id long, version binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions {mention}"
    doc, version, text = _key()
    return docs.select(doc.alias("doc_id"), version.alias("version"), text.alias("text")).mapInArrow(run, schema)


def score(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern) and instances (instance) worth trusting, from edges (pattern, instance, seed, n)."""
    trusted = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    before = -1
    while True:
        known = edges.join(trusted, "instance")
        sure = F.col("trust") >= CONFIDENT
        patterns = known.groupBy("pattern").agg(
            (F.sum(F.col("trust") * F.col("n")) / (F.sum("n") + 1)).alias("confidence"), F.sum(sure.cast("int")).alias("support")
        )
        patterns = common.store(patterns.filter(F.col("support") >= SUPPORT), "patterns")
        reach = edges.join(patterns, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("reached")
        )
        # trust never falls, so rounds end when no instance has become sure
        grown = trusted.join(reach, "instance", "left").select("instance", F.greatest("trust", F.when(F.col("reached") >= CONFIDENT, F.col("reached"))).alias("trust"))
        trusted = common.store(grown, "instances")
        now = trusted.filter(sure).count()
        if now == before:
            return patterns.filter(F.col("confidence") >= CONFIDENT).select("pattern"), trusted.filter(sure).select("instance")
        before = now


def context_spans(scanned: DataFrame) -> DataFrame:
    """doc_id, version and the spans (start, end) that confident patterns reveal."""
    each = scanned.select("doc_id", "version", F.explode("mentions").alias("m"))
    paths = each.select("doc_id", "version", "m.start", "m.end", "m.seed", "m.base", "m.instance", F.explode("m.patterns").alias("pattern"))
    edges = paths.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    patterns, instances = score(common.store(edges, "edges"))
    new = paths.filter(~F.col("base")).join(patterns, "pattern").join(instances, "instance")
    spans = new.select("doc_id", "version", "start", "end").distinct()
    return spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("revealed"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_context and n_spans (all kinds) of every row."""
    common.prepare(docs.sparkSession)
    scanned = common.store(scan(docs), "scanned")
    revealed = context_spans(scanned).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "revealed")
    rows = scanned.drop("mentions").join(revealed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v")), "left")
    named = F.transform("revealed", lambda s: F.concat_ws(":", F.lit(CONTEXT), s["start"].cast("string"), s["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(named, ","))
    n_context = F.coalesce(F.size("revealed"), F.lit(0)).cast("long")
    n_spans = n_context + sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), n_context.alias("n_context"), n_spans.cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with their columns, every span in the text replaced by its kind in angle brackets; n_chars follows."""
    common.prepare(docs.sparkSession)
    doc, version, revealed = common.free_names(docs, "key_doc", "key_version", "revealed")
    spans = context_spans(common.store(scan(docs), "scanned")).toDF(doc, version, revealed)
    own_doc, own_version, _ = _key()
    rows = docs.join(spans, own_doc.eqNullSafe(F.col(doc)) & (own_version == F.col(version)), "left")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            some = pc.fill_null(pc.match_substring_regex(batch["text"], "[0-9@+]"), False).to_pylist()
            texts = []
            for text, has, more in zip(batch["text"].to_pylist(), some, batch[revealed].to_pylist(), strict=True):
                if has:
                    spans = base_spans(text) + [(CONTEXT, s["start"], s["end"]) for s in more or []]
                    parts, done = [], 0
                    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            parts += [text[done:a], f"<{kind.upper()}>"]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = [batch[c] for c in names]
            columns[at] = pa.array(texts, batch["text"].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    clean = rows.select(*names, revealed).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*names)
