"""URL filter over a sorted digest array.

Rules and block-list entries are strings ``host/path-prefix``. Their 64-bit xxhash keys are kept as one sorted array
in a file that Spark hands to every executor; tasks map it into memory, so the workers of a machine share its pages,
and probe a whole batch of URLs with one vectorised binary search. Every key that is found is confirmed against the
stored string. An entry fits a URL if its host is the URL's host or a parent domain of it and the URL's path starts
with the entry's path; only such cuts of host and path are probed whose lengths occur in the list. The longest
fitting rule gives the verdict; a URL without a rule is blocked if any block-list entry fits it, and allowed if not.

A list larger than ``most_entries`` is cut into files of that size, each probed in turn, so a task never maps more.
A null URL, or one without ``://``, has an empty host and path and fits nothing. Repeated URLs are judged alike;
repeated entries count once, and a rule that both allows and blocks is refused. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtriage.sources.workspace import workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The rules of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The default block list: hosts of advertising, gambling, adult, pill and spam sites.
BLOCK_LIST = (
    "ads-track.example.com/",
    "adult-x.example.com/",
    "casino-win.example.net/",
    "cheap-pills.example.net/",
    "free-bets.example.net/",
    "spam-farm.example.org/",
)
MOST_ENTRIES = 1 << 22
_LISTED, _ALLOW, _BLOCK = 1, 2, 4
_HEADER = "<QQ"


def pack(entries: Sequence[tuple[str, int]]) -> bytes:
    """The file of a list: counts, sorted keys, offsets, kinds, and the strings in the order of the keys."""
    keyed = sorted((xxhash.xxh64_intdigest(raw), raw, kind) for raw, kind in ((s.encode(), k) for s, k in entries))
    blob = b"".join(raw for _, raw, _ in keyed)
    keys = np.array([key for key, _, _ in keyed], "<u8")
    ends = np.cumsum([0, *(len(raw) for _, raw, _ in keyed)]).astype("<u8")
    kinds = np.array([kind for _, _, kind in keyed], "<u8")
    return struct.pack(_HEADER, len(keyed), len(blob)) + keys.tobytes() + ends.tobytes() + kinds.tobytes() + blob


class DigestArray:
    """A mapped list file."""

    def __init__(self, path: str):
        data = np.memmap(path, "u1", "r")
        at = struct.calcsize(_HEADER)
        n, size = struct.unpack(_HEADER, data[:at].tobytes())
        self.keys = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.kinds = data[at + 16 * n + 8 : at + 24 * n + 8].view("<u8")
        self.blob = data[at + 24 * n + 8 : at + 24 * n + 8 + size]

    def find(self, probes: list[bytes]) -> list[int]:
        """The kind of each probed string, 0 if it is not listed."""
        found = [0] * len(probes)
        if not probes or not len(self.keys):
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), "<u8", len(probes))
        first = np.searchsorted(self.keys, keys)
        inside = np.minimum(first, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[inside] == keys).tolist():
            at = int(first[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:  # keys that collide stand side by side
                if self.blob[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == probes[i]:
                    found[i] = int(self.kinds[at])
                    break
                at += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for at in (rest.find("?"), rest.find("#")) if at >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.encode().lower().decode(), slash + path


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _entries(
    rules: Sequence[tuple[str, str]], block_list: Sequence[str]
) -> tuple[list[tuple[str, int]], dict[int, list[int]]]:
    kinds: dict[str, int] = {}
    for entries, kind_of in ((rules, {"allow": _ALLOW, "block": _BLOCK}), ([(x, "") for x in block_list], {"": _LISTED})):
        for entry, verdict in entries:
            host, slash, path = entry.partition("/")
            if not host or not slash:
                raise ValueError(f"an entry is a host, a slash and the start of a path: {entry!r}")
            name = f"{_lower(host)}/{path}"
            kinds[name] = kinds.get(name, 0) | kind_of[verdict]
            if kinds[name] & _ALLOW and kinds[name] & _BLOCK:
                raise ValueError(f"a rule both allows and blocks: {name!r}")
    lengths: dict[int, set[int]] = {}
    for name in kinds:
        host, _, path = name.partition("/")
        lengths.setdefault(len(host), set()).add(len(path) + 1)
    return sorted(kinds.items()), {h: sorted(p) for h, p in lengths.items()}


def _publish(spark: SparkSession, data: bytes) -> str:
    """The file's name among those that Spark hands to executors; it is kept in the shared folder."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{workspace(spark, 'url-filter')}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    block_list: Sequence[str] = BLOCK_LIST,
    id_col: str = "page_id",
    url_col: str = "url",
    most_entries: int = MOST_ENTRIES,
) -> DataFrame:
    """``page_id, host, path, rule, listed, verdict`` for every row. ``rule``: the longest rule that fits, or null;
    ``listed``: the longest block-list entry that fits, or null."""
    entries, lengths = _entries(rules, block_list)
    host_lengths = sorted(lengths)
    files = [
        _publish(pages.sparkSession, pack(entries[i : i + most_entries])) for i in range(0, len(entries), most_entries)
    ]

    def cuts(host: str, path: str) -> list[str]:
        starts = [0] if len(host) in lengths else []
        at = host.find(".", max(0, len(host) - host_lengths[-1] - 1)) if host_lengths else -1
        while at >= 0:
            if len(host) - at - 1 in lengths:
                starts.append(at + 1)
            at = host.find(".", at + 1)
        found = []
        for start in dict.fromkeys(starts):
            sizes = lengths[len(host) - start]
            found += [host[start:] + path[:n] for n in sizes[: bisect.bisect_right(sizes, len(path))]]
        return found

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [DigestArray(SparkFiles.get(name)) for name in files]
        for batch in batches:
            split = [split_url(url) for url in batch.column("url").to_pylist()]
            probes, owner = [], []
            for i, (host, path) in enumerate(split):
                if path and host:
                    own = cuts(host, path)
                    probes += own
                    owner += [i] * len(own)
            raw = [p.encode() for p in probes]
            rule: list[str | None] = [None] * len(split)
            listed: list[str | None] = [None] * len(split)
            verdict = ["allow"] * len(split)
            for array in arrays:
                for i, probe, kind in zip(owner, probes, array.find(raw), strict=True):
                    if kind & (_ALLOW | _BLOCK) and len(probe) > len(rule[i] or ""):
                        rule[i], verdict[i] = probe, "allow" if kind & _ALLOW else "block"
                    if kind & _LISTED and len(probe) > len(listed[i] or ""):
                        listed[i] = probe
            verdict = [
                "block" if rule[i] is None and listed[i] is not None else x for i, x in enumerate(verdict)
            ]
            columns = [batch.column("page_id"), [h for h, _ in split], [p for _, p in split], rule, listed, verdict]
            yield pa.RecordBatch.from_arrays(
                [columns[0], *(pa.array(c, pa.string()) for c in columns[1:])],
                names=["page_id", "host", "path", "rule", "listed", "verdict"],
            )

    urls = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return urls.mapInArrow(
        judge, "page_id long, host string, path string, rule string, listed string, verdict string"
    )
