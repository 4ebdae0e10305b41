"""URL filter: glob rules as one bit-parallel Shift-And automaton in several 64-bit words.

A rule is a glob over "." + host + "#" + path: the host is what stands between the first "://" and the next "/", "?", "#" or
the end, with A-Z in lower case; the path goes on to "?", "#" or the end. "#" stands in neither, so a rule's host part can't run into
the path. In a rule's host part "*" means any characters but "#"; in its path part it means any characters.

Site rules see host and path as the URL writes them. Block globs see their canonical form (canonical()), so other spellings of
an address don't pass them: unreserved characters that are percent-encoded are decoded, A-Z is lower case in both, the host has no user
part, port or trailing dots, and the path begins with "/" and has no dot segments.

Each glob position is one bit. Reading a character c moves all rules at once:
    state = (((state << 1) | begin) & enters[c]) | (state & stays[c])
and one numpy operation moves all URLs of a batch. Rules cost bits, not passes; a batch costs as many steps as its longest
URL has characters, and each step touches only URLs that are that long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of the query's contract: host, path, verdict. The longest that fits wins.
SITE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Globs that block where no site rule speaks: kinds of hosts and paths that carry no text worth training on.
BLOCK_GLOBS = [
    "*.spam-farm.*#*", "*.casino*#*", "*.cheap-pills.*#*", "*.free-bets.*#*", "*.ads-track.*#*", "*.ads.*#*", "*.adserver*#*",
    "*.tracker.*#*", "*.doubleclick.*#*", "*.porn*#*", "*.xxx.*#*", "*#*/wp-login*", "*#*/wp-admin/*", "*#*/cgi-bin/*", "*#*.exe",
    "*#*.zip", "*#*.jpg", "*#*.png", "*#*.gif", "*#*.mp4", "*#*.css", "*#*.js",
]

_SEPARATOR = ord("#")
#: Percent-encoded letters, digits, "-", ".", "_" and "~".
ENCODED = "%(?:2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])"
_ENCODED = re.compile(ENCODED)
_TO_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class Automaton(NamedTuple):
    words: int
    #: by character below 256 (255 stands for all others): bits that the character lets be entered, and stayed in
    enters: np.ndarray
    stays: np.ndarray
    begin: np.ndarray
    #: word and bit of each rule's last position
    final: list[tuple[int, np.uint64]]


def site_glob(host: str, path: str) -> str:
    """A rule for a host, its subdomains and the paths that begin as given."""
    return f"*.{host}#{path}*"


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path as block globs see them. "%" isn't unreserved, so "%2561" stays. An empty host has "/" as path if it has none."""
    if "%" in host or "%" in path:
        host, path = (_ENCODED.sub(lambda m: chr(int(m[0][1:], 16)), x) for x in (host, path))
    host, path = host.translate(_TO_LOWER), path.translate(_TO_LOWER)
    host = re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2]).rstrip(".")
    if "/." in path:
        kept: list[str] = []
        parts = path[1:].split("/")
        for part in parts:
            if part == "..":
                del kept[-1:]
            elif part != ".":
                kept.append(part)
        if parts[-1] in (".", ".."):
            kept.append("")
        path = "/" + "/".join(kept)
    return host, path or "/"


def compile_globs(globs: list[str]) -> Automaton:
    """Bits of a rule: one in front, always on while the rule begins with it, then one for each character that isn't "*".

    "*" after a character makes that character's bit stay on. A glob has exactly one "#"; "?" is any one character of its part.
    """
    entered: list[tuple[str, bool]] = []  # a character, "" in front of a rule; what stays: 0 nothing, 1 all but "#", 2 all
    loops: list[int] = []
    chars: list[str] = []
    final_at = []
    for glob in globs:
        if glob.count("#") != 1:
            raise ValueError(f"a rule is host#path: {glob!r}")
        chars.append("")
        loops.append(0)
        in_path = False
        for c in glob:
            if c == "*":
                loops[-1] = 2 if in_path else max(loops[-1], 1)
                continue
            in_path = in_path or c == "#"
            chars.append(c)
            loops.append(0)
        final_at.append(len(chars) - 1)
    words = -(-len(chars) // 64)
    enters, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    begin = np.zeros(words, np.uint64)
    any_but = np.arange(256) != _SEPARATOR
    for i, (c, loop) in enumerate(zip(chars, loops, strict=True)):
        w, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
        if c == "":
            begin[w] |= bit
        elif c == "?":
            enters[any_but, w] |= bit
        else:
            if not 0 < ord(c) < 255:
                raise ValueError(f"rules are written in characters below U+00FF: {c!r}")
            enters[ord(c), w] |= bit
        if loop:
            stays[any_but if loop == 1 else slice(None), w] |= bit
    return Automaton(words, enters, stays, begin, [(i // 64, np.uint64(1) << np.uint64(i % 64)) for i in final_at])


def matches(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """Which rule matches which whole text: a row for each text, a column for each rule."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.minimum(np.concatenate([np.zeros(0, np.uint32), *codes]), 255).astype(np.uint8)
    at = (np.cumsum(lengths) - lengths)[order]
    ranked = -lengths[order]
    state = np.tile(automaton.begin, (len(texts), 1))
    for step in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(ranked, -step, "left"))
        c = flat[at[:live] + step]
        old = state[:live]
        moved = old << np.uint64(1)
        moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
        state[:live] = (moved & automaton.enters[c]) | (old & automaton.stays[c])
    out = np.zeros((len(texts), len(automaton.final)), bool)
    for k, (w, bit) in enumerate(automaton.final):
        out[order, k] = (state[:, w] & bit) != 0
    return out


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    site_rules: list[tuple[str, str, str]] | None = None,
    block_globs: list[str] | None = None,
) -> DataFrame:
    """A verdict for each row: id, host, path, rule, verdict, n_globs (block globs that match), canonical (host and path as these see them).

    Block globs don't tell A-Z from a-z. Of the site rules that fit, the longest decides, and of equally long ones the first; else the URL is blocked if any block
    glob matches it. Null URLs and those without "://" have an empty host and path, "/" as canonical form, no rule, and are allowed. Repeated rows are
    judged each by itself; a null id is kept; other columns are not read. An empty table gives an empty result.
    """
    rules = SITE_RULES if site_rules is None else site_rules
    globs = BLOCK_GLOBS if block_globs is None else block_globs
    host = F.regexp_extract(F.col("_url"), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.col("_url"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    read = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url")).select(
        "_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path")
    )
    kind = read.schema["_id"].dataType.simpleString()
    names = [h + p for h, p, _ in rules]
    by_length = sorted(range(len(rules)), key=lambda i: -len(names[i]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites, blocks = compile_globs([site_glob(h, p) for h, p, _ in rules]), compile_globs([g.translate(_TO_LOWER) for g in globs])
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            forms = [canonical(h, p) for h, p in zip(hosts, paths, strict=True)]
            got = matches(sites, [f".{h}#{p}" for h, p in zip(hosts, paths, strict=True)])
            n_globs = matches(blocks, [f".{h}#{p}" for h, p in forms]).sum(axis=1)
            rule = np.full(len(hosts), -1)
            for i in reversed(by_length):
                rule[got[:, i]] = i
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([names[i] if i >= 0 else None for i in rule], pa.string()),
                    pa.array([rules[i][2] if i >= 0 else ("block" if n else "allow") for i, n in zip(rule, n_globs, strict=True)], pa.string()),
                    pa.array(n_globs.astype(np.int64)),
                    pa.array([h + p for h, p in forms], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict", "n_globs", "canonical"],
            )

    return read.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, n_globs bigint, canonical string")
