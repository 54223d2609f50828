"""Text analysis, queries, matching, ranking and highlighting.

An analysed text is an array of lexemes in order; a stop word is an empty string, so the
index in the array is the position. Known limits: words are runs of letters and digits
(no hyphenated words, URLs or tags), and positions aren't capped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.functions.stem import lexeme

WORD = r"[\p{L}\p{N}]+"
_TERM = re.compile(r'(-?)(?:"([^"]*)"|(\S+))')


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def analyze(column: Column, language: str) -> Column:
    """array<string> of lexemes; ``simple`` stays in the JVM, ``english`` stems in Arrow batches."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD), F.lit(0))
    if language == "simple":
        return tokens

    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: [lexeme(w, language) for w in ws])

    return stems(tokens)


@dataclass(frozen=True)
class ParsedQuery:
    positive: tuple[str, ...]
    negative: tuple[str, ...]


def parse_query(text: str | None) -> ParsedQuery:
    """Terms to find and to exclude: quoted phrases or runs of non-space, each once; and/or are no terms to find."""
    found: tuple[dict, dict] = ({}, {})
    for minus, phrase, word in _TERM.findall(text or ""):
        term = (phrase or word).strip()
        if term and (minus or term.casefold() not in ("and", "or")):
            found[bool(minus)].setdefault(term.casefold(), term)
    return ParsedQuery(tuple(found[0].values()), tuple(found[1].values()))


# --- query trees: ("lex", w), ("phrase", ((w, place), ...)), ("and"|"or", nodes), ("not", node), None for no lexeme


def _phrase(text: str, language: str):
    words = [(lexeme(w, language), i) for i, w in enumerate(words_of(text))]
    words = [(w, i) for w, i in words if w]
    if not words:
        return None
    return ("lex", words[0][0]) if len(words) == 1 else ("phrase", tuple((w, i - words[0][1]) for w, i in words))


def _all(kind: str, nodes: list):
    nodes = [n for n in nodes if n]
    return None if not nodes else nodes[0] if len(nodes) == 1 else (kind, tuple(nodes))


def plain_query(text: str, language: str):
    return _all("and", [("lex", x) for x in dict.fromkeys(lexeme(w, language) for w in words_of(text)) if x])


def phrase_query(text: str, language: str):
    return _phrase(text, language)


def web_query(text: str, language: str):
    """Words are all needed, ``or`` parts alternatives, quotes make phrases, ``-`` excludes."""
    groups: list[list] = [[]]
    for minus, phrase, word in _TERM.findall(text):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        node = _phrase(phrase or word, language)
        if node:
            groups[-1].append(("not", node) if minus else node)
    return _all("or", [_all("and", g) for g in groups])


PARSERS = {"websearch": web_query, "plain": plain_query, "phrase": phrase_query}


def build_tree(parsed: ParsedQuery, text: str, *, language: str, parser: str = "websearch", match: str = "any", max_terms: int = 200, strict_phrases: bool = False):
    """Tree of a query. ``any``: of its positive side. ``all``: of the whole text, as the parser reads it. Exclusions are also handled apart, in both signals."""
    if match == "all":
        return PARSERS[parser](text, language)
    parse = phrase_query if strict_phrases else (plain_query if parser == "websearch" else PARSERS[parser])
    return _all("or", [parse(t, language) for t in parsed.positive[:max_terms]])


def lexemes(node) -> list[str]:
    if not node or node[0] == "not":
        return []
    if node[0] == "lex":
        return [node[1]]
    if node[0] == "phrase":
        return [w for w, _ in node[1]]
    return list(dict.fromkeys(w for n in node[1] for w in lexemes(n)))


def lexemes_all(node) -> list[str]:
    """The lexemes of a tree, those under a ``not`` too."""
    if not node:
        return []
    if node[0] == "not":
        return lexemes_all(node[1])
    if node[0] in ("lex", "phrase"):
        return lexemes(node)
    return list(dict.fromkeys(w for n in node[1] for w in lexemes_all(n)))


def matches(tokens: Column, node) -> Column:
    """Whether analysed texts satisfy a tree."""
    if not node:
        return F.lit(False)
    kind, value = node
    if kind == "lex":
        return F.array_contains(tokens, value)
    if kind == "phrase":
        # one reference to the tokens: in a filter they may be an expression, evaluated at each
        gaps = "".join(r"(?:[^ ]* ){%d}" % (at - before - 1) + re.escape(w) + " " for (w, at), (_, before) in zip(value[1:], value))
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).rlike(f" {re.escape(value[0][0])} {gaps}")
    if kind == "not":
        return ~matches(tokens, value)
    parts = [matches(tokens, n) for n in value]
    if kind == "or" and all(n[0] == "lex" for n in value):
        return F.arrays_overlap(tokens, F.array(*[F.lit(n[1]) for n in value]))
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)


def needs_presence(node) -> bool:
    """Whether only texts with at least one of the tree's lexemes can satisfy it."""
    if not node:
        return True
    kind, value = node
    if kind in ("and", "or"):
        return (any if kind == "and" else all)(needs_presence(n) for n in value)
    return kind != "not"


def matches_places(places: Column, node) -> Column:
    """Like ``matches``, of a map from lexeme to its positions that has at least the tree's lexemes."""
    if not node:
        return F.lit(False)
    kind, value = node
    if kind == "lex":
        return F.map_contains_key(places, value)
    if kind == "phrase":
        none = F.array().cast("array<int>")
        first, rest = F.coalesce(F.try_element_at(places, F.lit(value[0][0])), none), value[1:]
        return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.coalesce(F.try_element_at(places, F.lit(w)), none), p + at) for w, at in rest]))
    if kind == "not":
        return ~matches_places(places, value)
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [matches_places(places, n) for n in value])


def rank_places(found: DataFrame, node, how: str) -> DataFrame:
    """id, text_score of rows (id, places): ``rank_cd`` or ``rank_frequency`` of a map from lexeme to positions."""
    # places of lexemes under a not have no part in a score
    words, places = lexemes(node), F.col("places")
    if how == "rank" or not words:
        counts = [F.coalesce(F.size(F.try_element_at(places, F.lit(w))), F.lit(0)) for w in words]
        return found.select("id", (_frequency(counts) if words else F.lit(0.0)).alias("text_score"))
    places = F.map_filter(places, lambda w, _: w.isin(words))
    if only_words(node) is not None:
        return found.select("id", (F.size(F.flatten(F.map_values(places))) * F.lit(0.1)).alias("text_score"))

    def covers(frames):
        for f in frames:
            hits = [sorted((int(p), w) for w, ps in zip(ws, of) for p in ps) for ws, of in zip(f["words"], f["of"])]
            yield pd.DataFrame({"id": f["id"], "text_score": pd.Series([covers_of(h, node) for h in hits], index=f.index, dtype=float)})

    rows = found.select("id", F.map_keys(places).alias("words"), F.map_values(places).alias("of"))
    return rows.mapInPandas(covers, f"id {found.schema['id'].dataType.simpleString()}, text_score double")


def only_words(node) -> list[str] | None:
    """The lexemes of a plain OR, or None for a tree with more structure."""
    if node and node[0] == "lex":
        return [node[1]]
    if node and node[0] == "or" and all(n[0] == "lex" for n in node[1]):
        return list(dict.fromkeys(n[1] for n in node[1]))
    return None


def _holds(node, present: dict[str, set]) -> bool:
    kind, value = node
    if kind == "lex":
        return bool(present.get(value))
    if kind == "phrase":
        first, rest = value[0], value[1:]
        return any(all(p + at in present.get(w, ()) for w, at in rest) for p in present.get(first[0], ()))
    if kind == "not":
        return True
    return (all if kind == "and" else any)(_holds(n, present) for n in value)


def cover_density(tokens: list[str], node) -> float:
    """Sum over minimal covers of 0.1 / (1 + places in the cover that it doesn't use)."""
    wanted = set(lexemes(node))
    return covers_of([(i, w) for i, w in enumerate(tokens) if w in wanted], node)


def covers_of(hits: list[tuple[int, str]], node) -> float:
    """``cover_density`` of the places, in order, where the tree's lexemes are."""
    total, start = 0.0, 0
    while start < len(hits):
        present: dict[str, set] = {}
        for end in range(start, len(hits)):
            present.setdefault(hits[end][1], set()).add(hits[end][0])
            if _holds(node, present):
                break
        else:
            break
        begin, present = end, {}
        while True:
            present.setdefault(hits[begin][1], set()).add(hits[begin][0])
            if _holds(node, present):
                break
            begin -= 1
        used = end - begin + 1
        total += 0.1 / (1 + hits[end][0] - hits[begin][0] + 1 - used)
        start = begin + 1
    return total


def rank_cd(tokens: Column, node) -> Column:
    """Cover density. In a plain OR every occurrence is a cover of its own, which a count expresses."""
    words = only_words(node)
    if words is not None:
        return F.size(F.filter(tokens, lambda t: t.isin(words))) * F.lit(0.1)

    @F.pandas_udf("double")
    def covers(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: cover_density(list(ts), node))

    return covers(tokens)


def rank_frequency(tokens: Column, node) -> Column:
    """Frequency rank: for each lexeme 0.1 * sum of 1/j^2 over its occurrences, over pi^2/6, as a mean over the lexemes.

    Proximity inside AND and phrase queries isn't weighed.
    """
    words = lexemes(node)
    if not words:
        return F.lit(0.0)

    def count(word: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t == word))

    return _frequency([count(w) for w in words])


def _frequency(counts: list[Column]) -> Column:
    def one(n: Column) -> Column:
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + F.lit(0.1) / (j * j)) / F.lit(1.64493406685)).otherwise(0.0)

    return reduce(lambda a, b: a + b, [one(n) for n in counts]) / F.lit(float(len(counts)))


def highlight(text: str, wanted: set[str], language: str, fragments: int = 2, least: int = 8, most: int = 30, start: str = "<mark>", stop: str = "</mark>", escape: bool = True) -> str:
    """Up to ``fragments`` stretches of ``least`` to ``most`` words around hits, hits marked; the opening words if none hits.

    Words are taken from the text as it is, and each piece is escaped as it goes out.
    """
    import regex

    def out_of(piece: str) -> str:
        return piece.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if escape else piece

    spans = [(m.start(), m.end(), lexeme(m[0].lower(), language) in wanted) for m in regex.finditer(WORD, text)]
    hits = [i for i, s in enumerate(spans) if s[2]]
    if not spans:
        return ""
    parts, at = [], 0
    while at < len(hits) and len(parts) < fragments:
        a = hits[at]
        last = max(i for i in hits if i < a + most)
        b = min(len(spans), max(last + 1, a + least))
        a = max(0, min(a, b - least))
        parts.append((a, b))
        at = next((j for j, h in enumerate(hits) if h >= b), len(hits))
    out = []
    for a, b in parts or [(0, min(len(spans), least))]:
        piece, place = [], spans[a][0] if a else 0
        for s, e, hit in spans[a:b]:
            piece.append(out_of(text[place:s]) + (f"{start}{out_of(text[s:e])}{stop}" if hit else out_of(text[s:e])))
            place = e
        if b == len(spans):
            piece.append(out_of(text[place:]))
        out.append("".join(piece))
    return " ... ".join(out)
