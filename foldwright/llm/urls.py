"""Allow and block rules for urls, looked up in a sorted array of digests.

A rule is a host and the start of a path. The rules are stored once as three files:
their sorted 64-bit xxhash keys, offsets, and the full strings. Spark ships the files
to the executors, whose workers map them into memory, so all workers of a machine share
one copy. A batch of urls is cut at every (host length, path length) that some rule
has, the digests of these prefixes are found by vectorised binary search, and the
stored string confirms each hit, so equal digests of different strings cannot mislead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
# Size up to which rules are shipped to every executor; beyond it urls are joined to them.
SHIPPED_BYTES = 512 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def digest64(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def host_of(url: Column) -> Column:
    """What stands after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Rules as sorted digests with their strings and verdicts."""

    def __init__(self, folder: str, name: str):
        load = lambda kind, dtype: self._mapped(os.path.join(folder, f"{name}.{kind}"), dtype)
        self.keys, self.starts, self.blob = load("keys", "<u8"), load("starts", "<i8"), load("blob", "u1")
        self.shapes = [(int(h), int(p)) for h, p in load("shapes", "<i8").reshape(-1, 2)]

    @staticmethod
    def _mapped(path: str, dtype: str) -> np.ndarray:
        if os.path.getsize(path) == 0:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")

    @staticmethod
    def write(folder: str, name: str, rules: list[Rule], digest: Callable[[bytes], int] = digest64) -> list[str]:
        """Files of the index. Of rules with one host and path, a blocking one holds."""
        held: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict!r} is neither {ALLOW} nor {BLOCK}")
            key = (host.translate(str.maketrans(_UPPER, _LOWER)), path)
            held[key] = BLOCK if BLOCK in (verdict, held.get(key)) else ALLOW
        # The host's length tells host and path apart, the first byte is the verdict.
        entries = []
        for (host, path), verdict in held.items():
            text = _entry(host.encode(), path.encode())
            entries.append((digest(text), verdict[0].encode() + text))
        entries.sort()
        blob = b"".join(e for _, e in entries)
        starts = np.cumsum([0, *(len(e) for _, e in entries)]).astype("<i8")
        shapes = sorted({(len(h.encode()), len(p.encode())) for h, p in held})
        arrays = {
            "keys": np.array([k for k, _ in entries], "<u8"),
            "starts": starts,
            "blob": np.frombuffer(blob, "u1"),
            "shapes": np.array(shapes, "<i8").reshape(-1, 2),
        }
        for kind, values in arrays.items():
            values.tofile(os.path.join(folder, f"{name}.{kind}"))
        return [os.path.join(folder, f"{name}.{kind}") for kind in arrays]

    def probe(self, texts: list[bytes], digest: Callable[[bytes], int] = digest64) -> list[str | None]:
        """The verdict stored for each text, None where none is."""
        wanted = np.fromiter((digest(t) for t in texts), np.uint64, len(texts))
        first = np.searchsorted(self.keys, wanted, "left")
        last = np.searchsorted(self.keys, wanted, "right")
        out: list[str | None] = [None] * len(texts)
        for i in np.flatnonzero(last > first):
            for at in range(first[i], last[i]):  # one, unless digests collide
                stored = self.blob[self.starts[at] : self.starts[at + 1]].tobytes()
                if stored[1:] == texts[i]:
                    out[i] = BLOCK if stored[:1] == b"b" else ALLOW
        return out


def _entry(host: bytes, path: bytes) -> bytes:
    return len(host).to_bytes(4, "little") + host + path


@lru_cache(maxsize=4)
def _opened(folder: str, name: str) -> DigestArray:
    return DigestArray(folder, name)


def judge(index: DigestArray, hosts: list[bytes], paths: list[bytes], default: str) -> tuple[list, list]:
    """(rule, verdict) of each url; the longest fitting rule wins, first by host, then by path."""
    rules, verdicts = [None] * len(hosts), [default] * len(hosts)
    open_rows = np.arange(len(hosts))
    for host_size, path_size in sorted(index.shapes, reverse=True):
        at, texts = [], []
        for i in open_rows:
            host, path = hosts[i], paths[i]
            cut = len(host) - host_size
            fits = cut == 0 or cut > 0 and host[cut - 1 : cut] == b"."
            if fits and len(path) >= path_size and host:
                at.append(i)
                texts.append(_entry(host[cut:], path[:path_size]))
        if not at:
            continue
        found = set()
        for i, text, verdict in zip(at, texts, index.probe(texts)):
            if verdict:
                rules[i], verdicts[i] = text[4:].decode(), verdict
                found.add(i)
        if found:
            open_rows = np.array([i for i in open_rows if i not in found], dtype=np.int64)
    return rules, verdicts


def ship_rules(spark: SparkSession, rules: list[Rule]) -> str:
    """Write the index on the driver and have Spark copy it to every executor; its name."""
    name = f"rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="rules-")
    for file in DigestArray.write(folder, name, rules):
        spark.sparkContext.addFile(file)
    return name


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = ALLOW, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row; columns of those names are replaced.

    `rules` are (verdict, host, path start). A rule fits its host and all subdomains if
    the path begins with its path; the longest host wins, then the longest path.
    `rule` is the winner's host and path or NULL, `verdict` then `default`.

    Defined cases: a url that is NULL or has no '://' has empty host and path, and no rule
    fits an empty host; of a rule given twice with different verdicts the blocking one
    holds; no rules at all give `default` everywhere; repeated rows stay; an
    empty table stays empty. Rules beyond `SHIPPED_BYTES` are refused: load those as a
    table and use `filter_urls_by_join`.
    """
    if sum(len(h) + len(p) + 32 for _, h, p in rules) > SHIPPED_BYTES:
        raise ValueError("too many rules to copy to every executor: use filter_urls_by_join")
    name = ship_rules(pages.sparkSession, rules)
    parts = pages.drop("host", "path", "rule", "verdict")
    parts = parts.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))

    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = _opened(SparkFiles.getRootDirectory(), name)
        kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
        for hosts, paths in batches:
            cast = lambda a: a.cast(pa.large_binary()).to_pylist()
            found, verdicts = judge(index, cast(hosts), cast(paths), default)
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(verdicts, pa.string())], fields=list(kind))

    judged = F.arrow_udf(look_up, "rule string, verdict string")
    return parts.withColumn("_judged", judged("host", "path")).select(
        *parts.columns, F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict")
    )


def filter_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW, url: str = "url") -> DataFrame:
    """As `filter_urls`, for rules (verdict, host, path) of any number in a table.

    Distinct (host, path) pairs are cut at the host's dots and at every path length that
    some rule has; the pieces are joined to the rules by a hash and compared in full.
    """
    parts = pages.drop("host", "path", "rule", "verdict")
    parts = parts.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    held = rules.groupBy(F.translate("host", _UPPER, _LOWER).alias("_h"), F.col("path").alias("_p")).agg(
        F.min(F.col("verdict") == ALLOW).alias("_allow")
    )
    # One number per length of a rule's path: as many as urls are long, at most.
    lengths = sorted(r[0] for r in held.select(F.length("_p")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = parts.where("host <> ''").select("host", "path").distinct()
    cut = pairs.select("host", "path", F.explode(suffixes).alias("_h"))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    cut = cut.withColumn("_n", F.explode(fitting))
    cut = cut.withColumn("_p", F.expr("substring(path, 1, _n)"))
    best = cut.join(held, ["_h", "_p"]).groupBy("host", "path").agg(
        F.max(F.struct(F.length("_h").alias("a"), F.length("_p").alias("b"), F.concat("_h", "_p").alias("rule"), F.col("_allow").alias("allow"))).alias("_best")
    )
    verdict = F.when(F.col("_best").isNull(), default).when(F.col("_best.allow"), ALLOW).otherwise(BLOCK)
    return parts.join(best, ["host", "path"], "left").select(
        *parts.columns, F.col("_best.rule").alias("rule"), verdict.alias("verdict")
    )
