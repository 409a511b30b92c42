"""URL filters as a sort-merge range join over reversed-host keys.

A host written backwards by labels (``com.example.www.``) starts with the key of every host above it,
so the hosts under a rule are one interval of keys, and intervals of rules nest or are disjoint. Both
sides are dealt to ranges of (key, row id); a rule goes to each range that its interval meets. Inside a
range, both are sorted by key and one sweep keeps the stack of rules whose interval is open; the
rules of the stack whose path starts the url's path apply, and the longest (host and path) wins.

Range borders are quantiles of a bounded sample of (key, row id), so a host with a third of all rows is
cut like any other. They decide the balance only, never a result.

Null urls and urls without ``://`` have empty host and path and no rule. Rules with equal host and
path: block wins. Repeated pages give equal rows; an empty table gives none; without rules all rows
get the default.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, partitions

#: Keys sampled per range to place the borders.
SAMPLE_PER_RANGE = 60
DEFAULT = "allow"
#: Fixed values of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 1 << 30))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 1 << 30))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``www.example.com`` as ``com`` SOH ``example`` SOH ``www`` SOH: below any other character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``; ``rules``: verdict, host, path."""
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    ranges = partitions(spark)
    want = SAMPLE_PER_RANGE * ranges
    salted = urls.select("key", F.coalesce(F.col("page_id"), F.lit(0)).alias("id"))
    rows = salted.count()
    fraction = min(1.0, 1.5 * want / max(rows, 1))
    sample = sorted((r["key"], r["id"]) for r in salted.sample(fraction, seed=7).limit(4 * want).collect())
    borders = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    borders = sorted(set(borders))
    border_keys = [k.encode() for k, _ in borders]

    keyed = [(k.encode(), i) for k, i in borders]

    def deal(batches):
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            part = pa.array([bisect_right(keyed, (k.encode(), i or 0)) for k, i in zip(keys, ids, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    def deal_rules(batches):
        for batch in batches:
            out = []
            for verdict, host, path in batch[["verdict", "host", "path"]].itertuples(index=False):
                low = b"\x01".join(reversed(host.encode().split(b"."))) + b"\x01"
                first = bisect_left(border_keys, low)
                last = bisect_left(border_keys, low[:-1] + b"\x02")
                out += [(p, low, verdict, host, path) for p in range(first, last + 1)]
            yield pd.DataFrame(out, columns=["part", "low", "verdict", "host", "path"])

    left = urls.mapInArrow(deal, "page_id long, host string, path string, key string, part int")
    right = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("verdict"))
        .select("verdict", "host", "path")
        .mapInPandas(deal_rules, "part int, low binary, verdict string, host string, path string")
    )

    def sweep(urls: pa.Table, rules: pa.Table) -> pa.Table:
        keys = [k.encode() for k in urls["key"].to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        pending = sorted(zip(*(rules[c].to_pylist() for c in ("low", "host", "path", "verdict")), strict=True))
        paths = urls["path"].to_pylist()
        names, verdicts = [None] * len(keys), [default] * len(keys)
        stack: list[tuple[bytes, list[tuple[str, str, str]]]] = []
        at = 0
        for i in order:
            key = keys[i]
            while at < len(pending) and pending[at][0] <= key:
                low, host, path, verdict = pending[at]
                at += 1
                while stack and not low.startswith(stack[-1][0]):
                    stack.pop()
                if not stack or stack[-1][0] != low:
                    stack.append((low, []))
                stack[-1][1].append((host, path, verdict))
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = None
            for _, group in stack:
                for host, path, verdict in group:
                    if paths[i].startswith(path):
                        size = len(host) + len(path)
                        if best is None or size >= best[0]:
                            best = (size, host + path, verdict)
            if best:
                names[i], verdicts[i] = best[1], best[2]
        judged = {"rule": pa.array(names, pa.string()), "verdict": pa.array(verdicts, pa.string())}
        return pa.table({**{c: urls[c] for c in ("page_id", "host", "path")}, **judged})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(
        sweep, "page_id long, host string, path string, rule string, verdict string"
    )
