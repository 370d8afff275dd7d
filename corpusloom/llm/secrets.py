"""Secret scans: fixed patterns, and random strings found by their few characters for each token."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import table

#: Order of kinds that begin at one place.
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidate strings: long runs of letters, digits and the marks of base64 and names.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Passwords with marks that names, paths and numbers lack.
_MARKED, _MARKS = re.compile(r"[A-Za-z0-9!@#$%^&*]{16,}"), "!@#$%^&*"
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: UUIDs, strings of hexadecimal digits, and digests in base64 behind the name of their function, within a run.
_KNOWN = re.compile(r"(?<![0-9a-zA-Z])(?:" + _UUID.pattern + r"|[0-9a-fA-F]{32,})(?![0-9a-zA-Z])")
_NAMED = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-:=](?:[A-Za-z0-9+/]{86}==|[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{38}==|[A-Za-z0-9+/]{27}=|[A-Za-z0-9+/]{22}==)(?![A-Za-z0-9+/=])", re.IGNORECASE)
#: Characters of a random string at least, parts between marks that one may have, and characters of parts that are not plain.
LEAST, STRETCH, EVIDENCE = 16, 16, 8
#: A part of an identifier between marks: words in one case or with a capital, a few digits at the end.
_PART, _CASED = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]{2,}+)*+[A-Z]?\d{0,4}"), re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Other plain parts: numbers, with a few letters behind or within (dates, versions, items of lists), names
#: with at most one capital inside and a number, short hashes of commits.
_PLAIN = re.compile(r"\d+|\d+[A-Za-z]{1,3}\d{0,4}|[A-Za-z][a-z]{0,8}(?:[A-Z][a-z]{1,8})?\d{1,5}(?:[a-z]\d{0,2})?|[A-Z]{1,8}\d{1,5}|g?[0-9a-f]{7,12}|0x[0-9a-fA-F]{1,16}")
#: Letters for each word of an identifier on average where capitals join several (noise of mixed case has
#: fewer), and in any one of them at most (longer words are judged by their tokens).
WORD_LETTERS, LONGEST_WORD = 4, 12
#: Letters of one case are often prose: they must have fewer characters for each token, and fewer vowels than words do.
ONE_CASE, VOWELS = 0.95, 0.4
#: Strings with marks have fewer characters for each token still.
WITH_MARKS = 0.8
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}


def default_ranks() -> str:
    """Path of the tiktoken ranks that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(part: str) -> bool:
    """Words in one case or joined by capitals, neither too short nor too long, and at most four digits at the end."""
    if not _PART.fullmatch(part):
        return False
    sizes = list(map(len, _CASED.findall(part)))
    return max(sizes, default=0) <= LONGEST_WORD and (len(sizes) < 2 or sum(sizes) >= WORD_LETTERS * len(sizes))


def is_plain(part: str) -> bool:
    """A part that says nothing by itself: a word, a name, a number, or too short."""
    return len(part) <= 5 or bool(_PLAIN.fullmatch(part)) or is_identifier(part)


def is_excluded(run: str) -> bool:
    """Known digests, UUIDs and identifiers, dates and versions are not random secrets."""
    if len(run) in _DIGESTS and not re.search("[^0-9a-fA-F]", run):
        return True
    return bool(_UUID.fullmatch(run)) or sum(len(p) for p in re.split("[-_/+=]+", run) if not is_plain(p)) < EVIDENCE


def is_random(run: str, ranks: str, most_chars_per_token: float) -> bool:
    """A string with letters and few characters for each token, and nothing known."""
    if len(run) < LEAST or not re.search("[A-Za-z]", run) or is_excluded(run):
        return False
    if 2 * sum(ord(b) - ord(a) == 1 for a, b in zip(run, run[1:])) > len(run):  # an alphabet
        return False
    if re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", run):
        if len(re.findall("[aeiouAEIOU]", run)) > VOWELS * len(run):
            return False
        most_chars_per_token *= ONE_CASE
    return len(run) <= most_chars_per_token * len(_encoding(ranks).encode_ordinary(run))


def marked_strings(text: str, taken: list[tuple[int, int]], ranks: str, most_chars_per_token: float) -> list[tuple[int, int]]:
    """Spans of random strings with ``!@#$%^&*`` inside, outside the spans ``taken``; marks at the ends are left out."""
    found = []
    for m in _MARKED.finditer(text):
        s = m[0].strip(_MARKS)
        if len(s) < LEAST and re.search(r"\d", s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
            s = m[0]  # short of the length without them
        at = m.start() + m[0].index(s) if s else m.start()
        marks = sum(c in _MARKS for c in s)
        if len(s) < LEAST or not marks or 3 * marks > len(s) or len(re.findall("[A-Za-z]", s)) < 4:
            continue
        if any(a < at + len(s) and at < e for a, e in taken) or all(map(is_plain, re.split("[!@#$%^&*]+", s))) and not re.search("[a-z]", s):
            continue
        if len(s) <= WITH_MARKS * most_chars_per_token * len(_encoding(ranks).encode_ordinary(s)):
            found.append((at, at + len(s)))
    return found


def random_parts(run: str, at: int, taken: list[tuple[int, int]], ranks: str, most_chars_per_token: float) -> list[tuple[int, int]]:
    """Spans of random strings in a run that begins at ``at``, outside the spans ``taken``.

    A free run is scored whole, then any stretch of neighbouring parts between marks, so that a string
    glued to words is found as well as one that holds marks itself. The longest stretch that passes is
    taken whose first and last parts are not plain words; UUIDs and digests within are left out.
    """
    end = at + len(run)
    known = [(at + m.start(), at + m.end()) for m in _KNOWN.finditer(run) if is_excluded(m[0])]
    if not taken and not known and is_random(run, ranks, most_chars_per_token):
        return [(at, end)]
    parts = [(at + m.start(), at + m.end()) for m in re.finditer("[A-Za-z0-9]+", run)]
    parts = [(s, e, not is_plain(run[s - at : e - at])) for s, e in parts if not any(a < e and s < b for a, b in [*taken, *known])]
    found, k = [], 0
    while k < len(parts):
        last = k
        # a stretch holds no part that was left out: its parts are one mark apart or a few
        while last + 1 < len(parts) and last + 1 - k < STRETCH and not any(parts[last][1] <= a < parts[last + 1][0] for a, _ in [*taken, *known]):
            last += 1
        got = next((j for j in range(last, k - 1, -1) if parts[k][2] and parts[j][2] and is_random(run[parts[k][0] - at : parts[j][1] - at], ranks, most_chars_per_token)), None)
        if got is not None:
            # longer ones go on while their last parts pass
            while got - k + 1 >= STRETCH and got < len(parts) - 1 and parts[got + 1][2] and is_random(run[parts[got + 2 - STRETCH][0] - at : parts[got + 1][1] - at], ranks, most_chars_per_token) and not any(parts[got][1] <= a < parts[got + 1][0] for a, _ in [*taken, *known]):
                got += 1
            found.append((parts[k][0], parts[got][1]))
            k = got
        k += 1
    return found


def scan(text: str | None, ranks: str, most_chars_per_token: float) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text in code points, by start and kind."""
    if not text:
        return []
    found = []
    if _WORD.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    taken = [(s, e) for s, _, e in base] + [m.span() for m in _NAMED.finditer(text)]
    marked = marked_strings(text, taken, ranks, most_chars_per_token)
    found += [(s, 3, e) for s, e in marked]
    for m in _RUN.finditer(text):
        here = [(s, e) for s, e in [*taken, *marked] if s < m.end() and m.start() < e]
        found += [(s, 3, e) for s, e in random_parts(m[0], m.start(), here, ranks, most_chars_per_token)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def secret_spans(text: Column, ranks: str, most_chars_per_token: float = 2.0) -> Column:
    """Spans of secrets in a text, as an array of (kind, start, end), end exclusive, in code points.

    ``assign``: a key word, ``:`` or ``=`` and a value of 6 or more characters. ``access``: ``AKIA`` and
    capitals or digits, 20 or more. ``hex``: 24 or more lower-case hexadecimal digits. ``random``:
    other runs of 16 or more characters with a letter that have at most ``most_chars_per_token``
    characters for each token of the ranks (0.95 times that and few vowels if they are letters of one case,
    0.8 times if they hold marks of passwords), unless they are digests of a known length or behind the name
    of their function, UUIDs, or made of names, dates, numbers and versions; so are parts of a run between
    marks, or a stretch of parts.

    Whole texts are read; null and empty texts have no spans; repeated rows are scanned one by one.
    """

    @F.pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, ranks, most_chars_per_token)] for t in batch])

    return spans(text)


def scan_secrets(docs: DataFrame, ranks: str, most_chars_per_token: float = 2.0, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Documents with all their columns and the spans of secrets in ``out`` (which replaces a column of that name)."""
    return docs.withColumn(out, secret_spans(F.col(text_col), ranks, most_chars_per_token))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of secrets in every document."""
    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), default_ranks())
    spans = F.col("secret_spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return docs.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), n("random"))
