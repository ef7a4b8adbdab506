"""Secret scans: multipart credential linking.

Every whole text is scanned once for strong findings and for weak parts of credentials. Strong findings
(an assignment, an access key id, a long hex run) are always reported. A weak part is only reported when a
part that completes it stands within ``REACH`` code points in the same scope; a scope is a section between
blank lines. That is an interval join: the parts of all documents are rows, each is dealt to the cells of
width ``REACH`` that its interval touches, and parts meet in their document, scope and cell. A cell is a
few hundred characters of one text, so it holds few parts however many a document has, and no key is hot.

Weak parts, by role:

* ``user`` (access identifier): the value of user, username, login, client_id, account or key_id, or a mail address;
* ``opaque`` (secret): a string of 20 and more key characters with a digit (16 and more digits are a hex run);
* ``endpoint``: a URL, host.name:port, a bare host.name of three and more parts, or an IP address.

An ``opaque`` part needs an access identifier or an endpoint beside it, the two others need a secret. An
assignment and a hex run count as secrets, an access key id as an access identifier.

Defined results: a null text is an empty one, without findings; a null doc_id is an id like any other;
repeated rows each get a row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import carried, filled, slices, text_key, with_texts
from tarnlake.sources.scratch import settle

REACH = 200

# The kinds in the order in which spans at one place are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "user", "opaque", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "access", "user": "access", "endpoint": "endpoint"}

# The strong rules. Letters of the keywords in either case, ASCII only.
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, like [0-9a-f]+ of 16 and more

USER = re.compile(
    r"(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})",
    re.I | re.A,
)
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[^\s\"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])")
# Possessive, so that a run that holds no match is passed over once.
HOST = re.compile(r"(?<![A-Za-z0-9@.-])[a-z0-9][a-z0-9-]*+(?:\.[a-z0-9-]++){2,}")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SECTION = re.compile(r"\n[\x20\t]*\n")


def strong_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what is always reported, in no order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _key_like(value: str) -> bool:
    """With a digit: a long word is no key."""
    return any("0" <= c <= "9" for c in value)


def _host_like(value: str) -> bool:
    """An IP address, or a name whose last part is no number."""
    parts = value.split(".")
    if all(part.isdigit() for part in parts):
        return len(parts) == 4 and all(len(part) <= 3 and int(part) <= 255 for part in parts)
    return len(parts[-1]) >= 2 and parts[-1].isalpha()


def weak_spans(text: str, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak parts that overlap nothing strong. Without any access identifier or endpoint none can be completed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(1), "user", m.end(1)) for m in USER.finditer(text)]
        if ":" in text:
            found += [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    bare = []
    if "@" in text:
        bare += [(m.start(), "user", m.end()) for m in MAIL.finditer(text)]
    if "." in text:
        bare += [(m.start(), "endpoint", m.end()) for m in HOST.finditer(text) if _host_like(m.group())]
    found += _apart(bare, found)
    if found or any(kind == "access" for _, kind, _ in strong):
        opaque = [(m.start(), "opaque", m.end()) for m in OPAQUE.finditer(text) if _key_like(m.group())]
        found += _apart(opaque, bare)
    return _apart(found, strong)


def _apart(spans: list[tuple[int, str, int]], others: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The spans that overlap none of the others."""
    if not spans or not others:
        return sorted(spans)
    taken = sorted((s, e) for s, _, e in others)
    starts = [s for s, _ in taken]
    reach = [0, *accumulate((e for _, e in taken), max)]  # the furthest end of the first spans
    return [(start, kind, end) for start, kind, end in sorted(spans) if reach[bisect_left(starts, end)] <= start]


def listed(spans: list[tuple[int, str, int]]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in order)


PART = "struct<kind:string,start:int,end:int,scope:int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])
    for batch in slices(batches):
        counts, bases, digests, parts = [], [], [], []
        for text in filled(batch["text"]).to_pylist():
            strong = strong_spans(text)
            weak = weak_spans(text, strong)
            kinds = [kind for _, kind, _ in strong]
            counts.append([kinds.count(k) for k in KINDS[:3]])
            bases.append(listed(strong))
            digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            row = []
            if weak:
                breaks = [m.start() for m in SECTION.finditer(text)]
                scope = 0
                for start, kind, end in sorted(strong + weak):
                    while scope < len(breaks) and breaks[scope] < start:
                        scope += 1
                    row.append({"kind": kind, "start": start, "end": end, "scope": scope})
            parts.append(row)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"]]
            + [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            + [pa.array(digests), pa.array(bases), pa.array(parts, pa.list_(part))],
            names=["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """The findings of every row of ``docs`` and the parts that may complete each other."""
    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInArrow(
        _scan,
        "doc_id long, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
        f"parts array<{PART}>",
    )


def linked_parts(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_key, kind, start, end of the weak parts that another part in their scope completes."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = (
        scanned.where(F.size("parts") > 1)
        .dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.explode("parts").alias("p"))
        .select("doc_id", "text_key", "p.*")
        .withColumn("role", roles[F.col("kind")])
    )
    cells = F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach)))
    weak = parts.where(F.col("kind").isin(*KINDS[3:])).withColumn("cell", cells).alias("w")
    other = parts.withColumn("cell", cells).alias("o")
    meets = (
        F.col("w.doc_id").eqNullSafe(F.col("o.doc_id"))
        & (F.col("w.text_key") == F.col("o.text_key"))
        & (F.col("w.scope") == F.col("o.scope"))
        & (F.col("w.cell") == F.col("o.cell"))
        & (F.col("o.start") <= F.col("w.end") + reach)
        & (F.col("w.start") <= F.col("o.end") + reach)
        & ((F.col("w.role") == "secret") != (F.col("o.role") == "secret"))
    )
    found = weak.join(other, meets, "left_semi")
    return found.select("doc_id", "text_key", "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, counts, base_sha256 and ``found``, all spans by place.

    ``found`` is an array of (start, rank of the kind, end, kind), in the order spans are listed in.
    """
    scanned = settle(scan(docs), "secret-scan")  # read three times
    linked = (
        linked_parts(scanned, reach)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
    )
    right = linked.withColumnsRenamed({"doc_id": "r_doc", "text_key": "r_key"})
    match = scanned["doc_id"].eqNullSafe(right["r_doc"]) & (scanned["text_key"] == right["r_key"])
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))

    def span(start, end, kind):
        place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
        return F.struct(start.alias("start"), place.alias("rank"), end.alias("end"), kind.alias("kind"))

    strong = F.transform(
        base,
        lambda s: span(F.split(s, ":")[1].cast("int"), F.split(s, ":")[2].cast("int"), F.split(s, ":")[0]),
    )
    weak = F.transform(
        F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,end:int,kind:string>>")),
        lambda p: span(p["start"], p["end"], p["kind"]),
    )
    return scanned.join(right, match, "left").select(
        scanned["doc_id"],
        scanned["text_key"],
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_sort(F.concat(strong, weak)).alias("found"),
    )


def span_text(found):
    """The spans of ``found`` as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span of every text replaced by its kind, overlapping spans by that of the first."""
    columns = docs.columns
    found = secret_spans(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("text_key").alias("f_key"), "found")
    match = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_key") == F.col("f_key"))
    held = carried(docs).join(found, match, "left").select("row", "text", "found")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
                if spans:
                    pieces, at = [], 0
                    for span in spans:
                        if span["start"] >= at:
                            pieces += [text[at : span["start"]], mask.format(span["kind"])]
                        at = max(at, span["end"])
                    text = "".join([*pieces, text[at:]])
                texts.append(text)
            yield with_texts(batch, texts, columns)

    return held.mapInArrow(rows, docs.schema)
