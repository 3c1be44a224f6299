"""URL filter: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule (action, host, path) fits its host and all subdomains if the url's path starts with the rule's.
Among the rules that fit, the one with most host labels wins, then the one with the longest path; of two
equal rules with different actions ``block`` wins. Urls that no rule fits get ``default``.

Defined cases: a null url, one without ``://`` and one without a host have host and path '' and get
``default``; the text of a url is read whole; only ``page_id`` and ``url`` are read; repeated rows give
repeated results; an empty table gives an empty result; with no rules all urls get ``default``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import map_arrow

#: A broadcast trie larger than so many rules is refused.
MAX_RULES = 1_000_000
_END, _PART, _PATHS = "\0end", "\0part", "\0paths"
DDL = "page_id long, host string, path string, rule string, verdict string"
OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:at].translate(_LOWER), rest[at:]
    for c in "?#":
        tail = tail.split(c, 1)[0]
    return host, tail


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: reversed host labels, then under ``_PATHS`` whole path segments. A node's ``_END``
    holds (rule, action); ``_PART`` lists rules that end within a segment."""
    root: dict = {}
    for n, (action, host, path) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        rule = (host + path, action)
        if last:
            node.setdefault(_PART, []).append((last, rule))
            node[_PART].sort(key=lambda x: (-len(x[0]), x[1][1] != "block"))
        elif node.get(_END, rule)[1] != "block" or action == "block":
            node[_END] = rule
    return root


def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
    best = node.get(_END)
    segments = path.split("/")
    for i, segment in enumerate(segments):
        for part, rule in node.get(_PART, ()):
            if segment.startswith(part):
                best = rule
                break
        if i == len(segments) - 1 or "/" + segment not in node:
            return best
        node = node["/" + segment]
        best = node.get(_END, best)
    return best


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest rule that fits."""
    node, best = trie, None
    if not host:
        return None
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if _PATHS in node:
            best = _longest_path(node[_PATHS], path) or best
    return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = longest_match(trie, host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]], schema=OUT)

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), run, DDL)
