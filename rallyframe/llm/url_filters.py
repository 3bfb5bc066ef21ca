"""URL filters over a sorted digest array.

Keys (host and path of each rule) are hashed to 64 bits with xxhash and kept sorted in a file that workers
map into memory, beside the full strings. A batch of URLs is probed by a vectorised binary search; where a
digest is found, the stored string is compared, so collisions give no wrong answers.

A URL is looked up under each suffix of its host at a label and, for each, each path length that some rule
has; the longest rule that fits decides.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, shuffle_partitions

#: (verdict, host, path). Fixed by the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The array goes to every worker with the query, so its size is checked; larger lists go to `judge_dealt`.
MOST_BYTES = 64 << 20


class DigestArray:
    """Sorted 64-bit digests, offsets and full strings in one buffer: count, digests, offsets, strings."""

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view("<u8")[0])
        self.digests = buffer[8 : 8 + 8 * n].view("<u8")
        self.offsets = buffer[8 + 8 * n : 8 + 8 * (2 * n + 1)].view("<u8")
        self.strings = buffer[8 + 8 * (2 * n + 1) :]

    @staticmethod
    def pack(keys: Iterable[str], digest=xxhash.xxh64_intdigest) -> bytes:
        """Keys keep their place among equal digests; repeated keys are kept once."""
        raw = sorted({k.encode() for k in keys}, key=lambda k: (digest(k), k))
        ends = np.cumsum([0, *map(len, raw)]).astype("<u8")
        return np.array([len(raw)], "<u8").tobytes() + np.array([digest(k) for k in raw], "<u8").tobytes() + ends.tobytes() + b"".join(raw)

    @classmethod
    def mapped(cls, content: bytes) -> DigestArray:
        """Write `content` to a file of this worker and map it; the file's name is dropped at once, so nothing is left behind."""
        fd, path = tempfile.mkstemp(suffix=".digests")
        with os.fdopen(fd, "wb") as f:
            f.write(content)
        array = cls(np.memmap(path, np.uint8, "r"))
        os.unlink(path)
        return array

    def key(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Place of each key, or -1."""
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(high > low):
            out[i] = next((j for j in range(low[i], high[i]) if self.key(j) == keys[i]), -1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to `?`, `#` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def hosts_above(host: str, most: int) -> list[str]:
    """The host and what is left of it after each dot, of at most so many labels, as no rule's host has more."""
    labels = host.rsplit(".", most)
    if len(labels) > most:
        labels = labels[1:]
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to rows with `url`; such columns are replaced.

    Of rules of one length, that with the longer host wins; of rules that differ in the verdict alone, the later verdict by
    name (so block). Null url or one without `://`: host and path
    empty, so no rule fits and the verdict is `default`. Repeated rows are judged alike; empty table: no rows."""
    content = DigestArray.pack(f"{h}{p}" for _, h, p in rules)
    if len(content) > MOST_BYTES:
        raise ValueError(f"the rules' array has {len(content)} bytes, over {MOST_BYTES}; use judge_dealt with a table of rules")
    verdicts = {f"{h}{p}".encode(): v for v, h, p in sorted(rules)}
    path_sizes = sorted({len(p) for _, _, p in rules})
    most_labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = DigestArray.mapped(content)
        for hosts, paths in parts:
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                fits = [h + path[:n] for n in path_sizes if len(path) >= n for h in hosts_above(host, most_labels)]
                keys += [k.encode() for k in fits]
                owner += [i] * len(fits)
            rule, best = [None] * len(hosts), [-1] * len(hosts)
            for k in np.flatnonzero(array.find(keys) >= 0):
                if len(keys[k]) > best[owner[k]]:  # path sizes rise, so of equal lengths the first has the longer host
                    rule[owner[k]], best[owner[k]] = keys[k], len(keys[k])
            yield pd.DataFrame({"rule": [r and r.decode() for r in rule], "verdict": [verdicts[r] if r else default for r in rule]})

    host, path = host_and_path(F.col("url"))
    judged = bounded_batches(pages).drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    judged = judged.withColumn("_rule_found", look_up("host", "path"))
    return judged.withColumn("rule", F.col("_rule_found.rule")).withColumn("verdict", F.col("_rule_found.verdict")).drop("_rule_found")


def judge_dealt(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`judge` for a table of rules (verdict, host, path) of any size.

    Rules and the keys to look up are dealt by hash into shards; each shard sorts its own digest array and probes
    it. Keys are looked up once however many URLs have them, so a hot host is no hot shard. The driver sees only which path
    lengths and how many labels rules have."""
    shards = 4 * shuffle_partitions(pages.sparkSession)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    rules = rules.groupBy(F.concat("host", "path").alias("key"), F.length("host").alias("host_size")).agg(F.max("verdict").alias("verdict"))
    path_sizes = sorted(r[0] for r in rules.select(F.length("key") - F.col("host_size")).distinct().collect())
    most_labels = rules.agg(F.max(F.size(F.split(F.substring("key", F.lit(1), F.col("host_size")), "[.]")))).first()[0] or 1

    @F.pandas_udf("array<struct<key: string, host_size: int>>")
    def keys_of(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[{"key": h + p[:n], "host_size": len(h)} for n in path_sizes if len(p) >= n for h in hosts_above(host, most_labels)] for host, p in zip(hosts, paths, strict=True)])

    def probe(wanted: pa.Table, known: pa.Table) -> pa.Table:
        array = DigestArray.mapped(DigestArray.pack(known.column("key").to_pylist()))
        verdicts = dict(zip(known.column("key").to_pylist(), known.column("verdict").to_pylist(), strict=True))
        keys = wanted.column("key").to_pylist()
        hits = [keys[i] for i in np.flatnonzero(array.find([k.encode() for k in keys]) >= 0)]
        return pa.table({"key": pa.array(hits, pa.string()), "verdict": pa.array([verdicts[k] for k in hits], pa.string())})

    host, path = host_and_path(F.col("url"))
    judged = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    wanted = judged.select("host", "path").distinct().withColumn("k", F.explode(keys_of("host", "path"))).select("host", "path", "k.key", "k.host_size")
    found = wanted.select("key").distinct().select("key", shard).groupBy("shard").cogroup(rules.select("key", "verdict", shard).groupBy("shard")).applyInArrow(probe, "key string, verdict string")
    best = wanted.join(found, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "host_size")).alias("b"))
    out = judged.join(best.select("host", "path", F.col("b.key").alias("rule"), F.col("b.verdict").alias("verdict")), ["host", "path"], "left")
    return out.select(*judged.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
