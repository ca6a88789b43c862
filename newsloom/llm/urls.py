"""URL filters: a broadcast trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest pickled trie that is sent to executors; beyond it build() refuses.
MAX_BYTES = 64 << 20
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_ASCII_LOWER), rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


def build(rules: Iterable[tuple[str, str]]) -> dict:
    """(verdict, rule) pairs, a rule being host/path, to a trie.

    A node has the labels below it under "d", and under "p" the rules for its host: a trie over whole path segments whose
    node keeps under "r" the rules that end in it, as (rest of the last segment, verdict, rule). Of two equal rules the
    later one counts. The trie is bounded by the rules, and refused beyond MAX_BYTES.
    """
    root: dict = {}
    for verdict, rule in rules:
        host, _, path = rule.translate(_ASCII_LOWER).partition("/")[0], None, rule[len(rule.partition("/")[0]) :]
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("d", {}).setdefault(label, {})
        node = node.setdefault("p", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault("d", {}).setdefault(segment, {})
        node.setdefault("r", {})[last] = (verdict, rule)
    if len(pickle.dumps(root)) > MAX_BYTES:
        raise ValueError("the rules are too many to broadcast; split them by top-level domain")
    return root


def judge(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits, None without one.

    A rule fits its host and all hosts below it if the path starts with the rule's, character by character. Longest is
    counted in characters of the rule; equal lengths go to the longer host, whose rules are met later.
    """
    best: tuple[int, tuple[str, str]] | None = None
    segments, node = path.split("/"), trie
    for label in [*reversed(host.split(".")), None]:
        at = node.get("p")
        for segment in segments:
            if at is None:
                break
            for rest, found in at.get("r", {}).items():
                if segment.startswith(rest) and (best is None or len(found[1]) >= best[0]):
                    best = len(found[1]), found
            at = at.get("d", {}).get(segment)
        node = node.get("d", {}).get(label)
        if node is None:
            break
    return best and best[1]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict, a row for each row of pages.

    rule is null and the verdict is ``default`` where no rule fits. Null URLs and URLs without ``://`` have an empty host
    and path, which no rule with a host fits. Repeated rows are judged alike; columns of these four names are replaced;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(build(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = parts(u)
            verdict, rule = (host and judge(trie.value, host, path)) or (default, None)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in names]
    return pages.select(*kept, judged(F.col(url)).alias("__judged")).select(*kept, *(F.col(f"__judged.{c}").alias(c) for c in names))
