"""Secret scan: spans in each document, judged by how widely their value is owned in the whole corpus.

Base spans are matches of three fixed kinds. The method looks at further live-looking values (long, mixed
characters, high entropy) and counts, for the hash of every candidate, the distinct owners and repositories
that hold it. A value that only one owner holds, in few repositories, is a credential of that owner and gives a
span of kind ``owned``; one that several owners or many repositories hold is a copied example.

Defined results: null and empty texts have no spans; a null owner is an owner of its own, a null repository
likewise; repeated rows give one result row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stage

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the long ones among all maximal runs
LIVE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
PLACEHOLDER = re.compile(r"example|sample|dummy|change|placeholder|x{4,}|0{6,}|1234567", re.I)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str, bits: float) -> bool:
    return entropy(value) >= bits and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the three base kinds, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def more_candidates(text: str, base: list, bits: float) -> list[tuple[int, int, int, str]]:
    out = []
    for m in LIVE.finditer(text):
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)
        if mixed and looks_live(v, bits) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


_SCANNED = (
    "rid long, id string, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "found array<struct<start:int,kind:int,end:int,h:string,live:boolean>>"
)


def _scan(bits: float):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, key, repo, owner, text in pdf.itertuples(index=False):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                n = Counter(s[1] for s in base)
                every = sorted(base + more_candidates(text, base, bits))
                out.append((
                    rid, key, repo, owner, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(),
                    [{"start": a, "kind": k, "end": b, "h": hashlib.blake2b(v.encode(errors="surrogatepass"), digest_size=16).hexdigest(),
                      "live": looks_live(v, bits)} for a, k, b, v in every]))
            yield pd.DataFrame(out, columns=["rid", "id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return scan


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source",
         bits: float = 3.0, copied_from: int = 3) -> DataFrame:
    """One row per document: id, counts, checksum of the base spans, all spans, and what ownership says of them.

    ``n_specific`` live-looking values are held by one owner in fewer than ``copied_from`` repositories; ``n_copied`` values
    are held by several owners, or by one in ``copied_from`` repositories or more.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id).cast("string").alias("id"),
        F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    kept = stage(rows.mapInPandas(_scan(bits), _SCANNED), "secret-scan")
    found = kept.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("c")).select(
        "rid", "repo", "owner", "c.*")
    # Counted level by level, so that a value found everywhere is summed up before it is shuffled.
    owners = (
        found.groupBy("h", "owner", "repo").agg(F.count("*").alias("k"))
        .groupBy("h", "owner").agg(F.count("*").alias("repos"))
        .groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = found.join(owners, "h")
    specific = (F.col("owners") == 1) & (F.col("repos") < copied_from)
    shown = (F.col("kind") < 3) | specific
    spans = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(
            shown, F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s"))))).alias("all"),
        F.sum(F.when((F.col("kind") == 3) & specific, 1).otherwise(0)).alias("n_owned"),
        F.sum(F.when(specific & F.col("live"), 1).otherwise(0)).alias("n_specific"),
        F.sum(F.when(~specific, 1).otherwise(0)).alias("n_copied"))
    zero = F.lit(0).cast("long")
    return kept.drop("found").join(spans, "rid", "left").select(
        F.col("id").cast(dict(df.dtypes)[id]).alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("all", lambda x: x["s"]), ","), F.lit("")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_owned", "n_specific", "n_copied")])
