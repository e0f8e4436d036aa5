"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed, one after another, into the words of a Shift-And mask:
each pattern has a start bit and a bit for each of its symbols, and a star is a
self-loop on the bit before it. One shift, one and, and one or per URL byte
advance every pattern at once, for all URLs of an Arrow batch together.

Glob syntax, over host + path: ``*`` any run without '/', ``**`` any run,
``?`` one byte that is not '/'; all else stands for itself.

Defined results: a null url or one without '://' has an empty host and path and
gets the method's verdict for it (block: nothing to fetch). Repeated rows, ties
(the earlier rule of equal length wins) and extra columns are harmless; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import prepare

ONE = np.uint64(1)
OUT = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("glob_rule", pa.string())])


@dataclass(frozen=True)
class HostRule:
    """verdict for a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: The method's own globs, for URLs that no host rule fits: the longest that matches gives the verdict, none gives allow.
GLOBS = (
    ("block", "*spam*/**"),
    ("block", "*cheap-pills*/**"),
    ("block", "*casino*/**"),
    ("block", "**.exe"),
    ("block", "**.zip"),
    ("block", "**/login**"),
    ("block", "*/cart/**"),
)


def escape(text: str) -> list[tuple[str, bytes]]:
    return [("byte", bytes([b])) for b in text.encode()]


def parse(glob: str) -> list[tuple[str, bytes]]:
    """Symbols of a glob: ('byte', b), ('one', b''), ('star', b'') or ('deep', b'')."""
    out: list[tuple[str, bytes]] = []
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(("deep", b""))
            i += 2
        elif glob[i] in "*?":
            out.append(("star" if glob[i] == "*" else "one", b""))
            i += 1
        else:
            out += escape(glob[i])
            i += 1
    return out


@dataclass
class Automaton:
    """All patterns at once. patterns: lists of symbols as parse() gives them."""

    patterns: list[list[tuple[str, bytes]]]
    step: np.ndarray = field(init=False)
    loop: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    final: list[int] = field(init=False)

    def __post_init__(self) -> None:
        bits = sum(1 + sum(kind in ("byte", "one") for kind, _ in p) for p in self.patterns)
        words = max(1, -(-bits // 64))
        self.step = np.zeros((256, words), np.uint64)
        self.loop = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.final = []
        not_slash = [b for b in range(256) if b != 0x2F]
        at = 0
        for pattern in self.patterns:
            self.start[at // 64] |= ONE << np.uint64(at % 64)
            for kind, byte in pattern:
                if kind in ("byte", "one"):
                    at += 1
                    on = [byte[0]] if kind == "byte" else not_slash
                    self.step[on, at // 64] |= ONE << np.uint64(at % 64)
                else:
                    self.loop[not_slash if kind == "star" else slice(None), at // 64] |= ONE << np.uint64(at % 64)
            self.final.append(at)
            at += 1

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(len(urls), patterns) booleans. URLs advance together, the longest first, and leave when they end."""
        n = len(urls)
        order = sorted(range(n), key=lambda i: -len(urls[i]))
        sizes = np.array([len(urls[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        state = np.tile(self.start, (n, 1))
        live = n
        for i in range(int(sizes[0]) if n else 0):
            while live and sizes[live - 1] <= i:
                live -= 1
            now, byte = state[:live], data[begins[:live] + i]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        hit = np.zeros((n, len(self.patterns)), bool)
        for k, at in enumerate(self.final):
            hit[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & ONE
        return hit


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:stop]


class UrlFilter:
    """Judges URLs by host rules first (the longest that fits wins), then by globs."""

    def __init__(self, rules: tuple[HostRule, ...] = RULES, globs: tuple[tuple[str, str], ...] = GLOBS):
        self.rules, self.globs = list(rules), list(globs)
        patterns, self.owner = [], []
        for k, rule in enumerate(rules):
            tail = escape(rule.name) + [("deep", b"")]
            patterns += [tail, [("star", b""), ("byte", b"."), *tail]]
            self.owner += [k, k]
        patterns += [parse(g) for _, g in globs]
        self.automaton = Automaton(patterns)
        self.rule_rank = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))
        self.glob_rank = sorted(range(len(globs)), key=lambda k: (-len(globs[k][1]), k))

    def judge(self, urls: list[str | None]) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        hit = self.automaton.matches([(h + p).encode() for h, p in parts])
        n = len(self.rules)
        by_rule = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
        out: dict[str, list] = {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [], "verdict": [], "glob_rule": []}
        for i, (host, _) in enumerate(parts):
            rule = next((self.rules[k] for k in self.rule_rank if by_rule[i, k]), None)
            glob = None if rule else next((self.globs[k] for k in self.glob_rank if hit[i, 2 * n + k]), None)
            out["rule"].append(rule.name if rule else None)
            out["glob_rule"].append(glob[1] if glob else None)
            out["verdict"].append(rule.verdict if rule else glob[0] if glob else "allow" if host else "block")
        return out


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[HostRule, ...] = RULES, globs: tuple[tuple[str, str], ...] = GLOBS) -> DataFrame:
    """key, host, path, rule, verdict and glob_rule of every row; only the two named columns are read."""
    prepare(pages.sparkSession)
    source = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = UrlFilter(rules, globs)
        for batch in batches:
            got = judged.judge(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(got[f.name], f.type) for f in OUT)], names=["key", *OUT.names])

    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string, glob_rule string")
    return out.withColumnRenamed("key", key)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    host = "regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
    path = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [(f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')", r) for r in rules]
    globs = sorted(GLOBS, key=lambda g: -len(g[1]))

    def regex(glob: str) -> str:
        done = ""
        for kind, byte in parse(glob):
            done += {"star": "[^/]*", "deep": ".*", "one": "[^/]"}.get(kind) or (byte.decode() if byte.isalnum() else f"[{byte.decode()}]")
        return f"(?s)^{done}$"

    rule = " ".join(f"when {c} then '{r.name}'" for c, r in fits)
    verdict = " ".join(f"when {c} then '{r.verdict}'" for c, r in fits)
    glob = " ".join(f"when regexp_matches(host || path, '{regex(g)}') then '{g}'" for _, g in globs)
    of_glob = " ".join(f"when glob_rule = '{g}' then '{v}'" for v, g in GLOBS)
    ascii_lower = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with raw as (select page_id, case when contains(url, '://') then {host} else '' end h, case when contains(url, '://') then {path} else '' end path from pages),
parts as (select page_id, {ascii_lower} host, coalesce(path, '') path from raw),
judged as (select page_id, host, path, case {rule} end as rule, case {verdict} end as by_rule, case when not coalesce({' or '.join(f'({c})' for c, _ in fits)}, false) then case {glob} end end as glob_rule from parts)
select page_id, host, path, rule, coalesce(by_rule, case {of_glob} end, case when host = '' then 'block' else 'allow' end) as verdict, glob_rule from judged"""


ORACLE = _sql()
