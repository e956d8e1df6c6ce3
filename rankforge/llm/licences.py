"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences: at stops, semicolons and colons before white space, and at blank lines. A line end inside
a paragraph is white space, so wrapped notices are whole sentences, and signs that lead comment lines are no words. Each
normalised sentence that is known becomes an identifier; where a sentence as a whole is not known, its lines are tried, each
alone and with all that follow it, for notices between lines without a stop. The sequence of identifiers is then matched
against ordered licence rules, the longer sequences first: each rule consumes the identifiers it matches, so a whole
licence is named before the sentences it shares with others.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .licence_texts import NOTICES, SPDX

#: Signs that lead a comment line.
LEAD = r"(\A|\n)[ \t]*[;#!:*/>%-]+[ \t]*"
#: A stop with closing quotes or brackets before white space or the end; what is no letter, digit, line end or cut; blank lines.
STOP, PLAIN, BLANK = r"""[.!?;:]+["')\]]*([ \t\r\n]|\z)""", r"[^a-z0-9\n\x01]+", r"\n *(?:\n *)+"
CUT, HEAD_WORDS = "\x01", 3
#: Its colon ends no sentence.
SPDX_LEAD = "spdx-license-identifier"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences_of(text: str) -> list[str]:
    """Normalised sentences of a notice (the same cut as that of whole columns)."""
    t = text.translate(str.maketrans(_UPPER, _LOWER))
    t = re.sub(LEAD, r"\1", t.replace(SPDX_LEAD + ":", SPDX_LEAD))
    t = re.sub(PLAIN, " ", re.sub(STOP.replace(r"\z", r"\Z"), lambda m: CUT + m[1], t))
    t = re.sub(BLANK, CUT, t).replace("licence", "license")
    return [s for s in (" ".join(x.split()) for x in t.split(CUT)) if s]


def build_tables(notices: Sequence[tuple[str, int | None, str]] = NOTICES, spdx: Sequence[str] = SPDX) -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """(identifier -> sentence, rules): identifiers are the first licence that has the sentence and a number; a rule is a
    whole notice, or the one sentence that names a licence alone."""
    ids: dict[str, str] = {}
    count: dict[str, int] = {}
    rules: list[tuple[str, tuple[str, ...]]] = []

    def identifier(name: str, sentence: str) -> str:
        if sentence not in ids:
            count[name] = count.get(name, 0) + 1
            ids[sentence] = f"{name}#{count[name]}"
        return ids[sentence]

    for name, alone, text in notices:
        parts = tuple(identifier(name, s) for s in sentences_of(text))
        rules.append((name, parts))
        if alone is not None:
            rules.append((name, (parts[alone],)))
    rules += [(name, (identifier(name, sentences_of(f"{SPDX_LEAD}: {name}")[0]),)) for name in spdx]
    unique: dict[tuple[str, ...], str] = {}
    for name, parts in rules:
        unique.setdefault(parts, name)
    return {v: k for k, v in ids.items()}, tuple((name, parts) for parts, name in unique.items())


SENTENCES, RULES = build_tables()
#: The licence that any other one beside it outranks.
ALONE = "Proprietary"


def _heads(sentences: Mapping[str, str]) -> list[str]:
    return sorted({" ".join(s.split(" ")[:HEAD_WORDS]) for s in sentences.values()})


def telling_words(sentences: Mapping[str, str]) -> list[str]:
    """A few words such that each sentence has one of them: next always the word of most sentences that have none yet, of
    the longer words (prose has them less often) as long as a sentence has any."""
    left, out = [], []
    for s in sentences.values():
        words = set(s.replace("license", "licen").split(" "))
        left.append({w for w in words if len(w) > 7 or w == "licen"} or {w for w in words if len(w) > 2 and w.isalpha()} or words)
    while left:
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w], len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def known_sentences(text: Column, sentences: Mapping[str, str]) -> Column:
    """Known normalised sentences in order of the text."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    t = F.regexp_replace(F.replace(t, F.lit(SPDX_LEAD + ":"), F.lit(SPDX_LEAD)), LEAD, "$1")
    t = F.regexp_replace(F.regexp_replace(t, STOP, CUT + "$1"), PLAIN, " ")
    t = F.replace(F.regexp_replace(t, BLANK, CUT), F.lit("licence"), F.lit("license"))
    lower = F.lower(text)
    may = reduce(or_, [lower.contains(w) for w in telling_words(sentences)])  # most texts end here
    known, heads = list(sentences.values()), _heads(sentences)

    def of_lines(lines: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            rest = F.array_join(F.slice(lines, k + 1, F.size(lines)), " ")
            starts = F.substring_index(line, " ", HEAD_WORDS).isin(*heads)
            return F.when(starts, let(rest, lambda r: F.when(r.isin(*known), r).when(line.isin(*known), line)))

        return let(F.array_join(lines, " "), lambda whole: F.when(whole.isin(*known), F.array(whole)).otherwise(F.transform(lines, one)))

    lines = lambda s: F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    found = F.filter(F.flatten(F.transform(F.split(t, CUT, -1), lambda s: let(lines(s), of_lines))), lambda x: x.isNotNull())
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, alone: str = ALONE) -> DataFrame:
    """(id, sentence_ids, licences, n_unmatched): identifiers in order of the text, licences in order of the text, distinct,
    both joined by commas, and the number of known sentences that no rule consumed. The licence ``alone`` (a reservation of
    rights, which stands above many a licence) is named only where no other one is.

    Null and empty texts have none. Everything stays in the row: repeated rows repeat, a very long text is one row, other
    columns are not read and nothing is shuffled. An empty table gives no rows.
    """
    table = F.create_map(*[F.lit(x) for k, s in sentences.items() for x in (s, k)])
    ids = F.transform(known_sentences(F.col(f"`{text}`"), sentences), lambda s: F.element_at(table, s))
    out = docs.select(F.col(id_col), ids.alias("_ids"))
    # identifiers as [a][b]; a matched sequence becomes {licence}
    sequence = F.concat(F.lit(""), F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))
    for name, parts in sorted(rules, key=lambda r: -len(r[1])):
        sequence = F.replace(sequence, F.lit("".join(f"[{p}]" for p in parts)), F.lit("{" + name + "}"))
    sequence = F.when(F.size("_ids") > 0, sequence).otherwise("")
    named = F.array_distinct(F.regexp_extract_all("_seq", F.lit(r"\{([^}]*)\}"), F.lit(1)))
    others = F.array_remove(named, alone)
    named = F.when(F.size(others) > 0, others).otherwise(named)
    return out.withColumn("_seq", sequence).select(id_col, F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(named, ",").alias("licences"), F.regexp_count("_seq", F.lit(r"\[")).cast("long").alias("n_unmatched"))


def scan_sql(table: str = "documents", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, alone: str = ALONE) -> str:
    """DuckDB SQL of scan_licences, by joins of sentences and lines with the table of known ones."""
    rows = ", ".join(f"('{k}', '{s}')" for k, s in sentences.items())
    seq = "coalesce(string_agg('[' || k || ']', '' ORDER BY i, j) FILTER (WHERE k IS NOT NULL), '')"
    for name, parts in sorted(rules, key=lambda r: -len(r[1])):
        seq = f"replace({seq}, '{''.join(f'[{p}]' for p in parts)}', '{{{name}}}')"
    stop = STOP.replace("'", "''")
    return rf"""
WITH known(k, s) AS (VALUES {rows}),
m AS (SELECT row_number() OVER () AS r, doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SPDX_LEAD}:', '{SPDX_LEAD}'), '{LEAD}', '\1', 'g'), '{stop}', chr(1) || '\1', 'g'), '{PLAIN}', ' ', 'g'), '{BLANK}', chr(1), 'g'), 'licence', 'license') AS t FROM {table}),
p AS (SELECT r, doc_id, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM m),
l AS (SELECT r, doc_id, i, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p),
w AS (SELECT l.*, known.k FROM l LEFT JOIN known ON array_to_string(l.l, ' ') = known.s),
o AS (SELECT r, doc_id, i, unnest(l) AS line, generate_subscripts(l, 1) AS j, l FROM w WHERE k IS NULL),
h AS (SELECT r, doc_id, i, 0 AS j, k FROM w UNION ALL
    SELECT r, doc_id, i, j, coalesce(a.k, b.k) FROM o LEFT JOIN known a ON array_to_string(o.l[j:], ' ') = a.s LEFT JOIN known b ON o.line = b.s),
g AS (SELECT r, any_value(doc_id) AS doc_id, coalesce(string_agg(k, ',' ORDER BY i, j) FILTER (WHERE k IS NOT NULL), '') AS sentence_ids, {seq} AS seq FROM h GROUP BY r),
a AS (SELECT *, regexp_extract_all(seq, '\{{([^}}]*)\}}', 1) AS every FROM g),
e AS (SELECT *, CASE WHEN len(list_filter(every, lambda x: x <> '{alone}')) > 0 THEN list_filter(every, lambda x: x <> '{alone}') ELSE every END AS n FROM a)
SELECT doc_id, sentence_ids, array_to_string(list_filter(n, lambda x, j: list_position(n, x) = j), ',') AS licences,
    (length(seq) - length(replace(seq, '[', '')))::BIGINT AS n_unmatched FROM e
"""
