"""A boolean query language over documents, compiled to one Column.

Terms are words or quoted phrases, joined by upper-case AND, OR and NOT, with groups;
words side by side mean AND, and field tags in brackets are ignored.  A query without a
term matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ast = tuple | None

_TOKEN = re.compile(r'"([^"]*)"?|(\()|(\))|(\[[^\]]*\]?)|([^\s()"\[\]]+)')
_OPERATORS = {"AND": "and", "OR": "or", "NOT": "not"}
_LOOKS = re.compile(r'\b(?:AND|OR|NOT)\b|["()]|\[[A-Za-z/ ]+\]')


@dataclass(frozen=True)
class Token:
    kind: str  # term, and, or, not, open, close
    text: str = ""


def looks_boolean(text: str | None) -> bool:
    """Whether a text uses the language's signs: upper-case operators, quotes, groups or field tags."""
    return bool(text and _LOOKS.search(text))


def tokenize(query: str | None) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(query or ""):
        phrase, opening, closing, tag, word = m.groups()
        if opening:
            out.append(Token("open"))
        elif closing:
            out.append(Token("close"))
        elif phrase is not None:
            if phrase.strip():
                out.append(Token("term", " ".join(phrase.lower().split())))
        elif word in _OPERATORS:
            out.append(Token(_OPERATORS[word]))
        elif tag is None:
            out.append(Token("term", word.lower()))
    return out


class _Parser:
    """Precedence: NOT, then AND (spoken or not), then OR."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else "end"

    def level(self, kind: str, part) -> Ast:
        found = [x for x in [part()] if x]
        while self.peek() not in ("end", "close") and (self.peek() == kind or kind == "and" and self.peek() != "or"):
            if self.peek() == kind:
                self.at += 1
            found += [x for x in [part()] if x]
        return (kind, found) if len(found) > 1 else found[0] if found else None

    def either(self) -> Ast:
        return self.level("or", self.both)

    def both(self) -> Ast:
        return self.level("and", self.single)

    def single(self) -> Ast:
        kind = self.peek()
        if kind in ("end", "close", "or", "and"):
            return None
        token = self.tokens[self.at]
        self.at += 1
        if kind == "not":
            inner = self.single()
            return ("not", inner) if inner else None
        if kind == "open":
            inner = self.either()
            if self.peek() == "close":
                self.at += 1
            return inner
        return ("term", token.text)


def parse(query: str | list[Token] | None) -> Ast:
    """A tree of ("and" | "or", [...]), ("not", x) and ("term", text); None without a term."""
    parser = _Parser(tokenize(query) if not isinstance(query, list) else query)
    found = []
    while parser.peek() != "end":
        if (part := parser.either()) is not None:
            found.append(part)
        if parser.peek() == "close":
            parser.at += 1
        elif not part:
            parser.at += 1
    return ("and", found) if len(found) > 1 else found[0] if found else None


def leaves(ast: Ast) -> list[str]:
    if ast is None:
        return []
    if ast[0] == "term":
        return [ast[1]]
    return [t for x in ([ast[1]] if ast[0] == "not" else ast[1]) for t in leaves(x)]


def predicate(ast: Ast, *texts: Column) -> Column:
    """True for documents that match; terms are substrings, not patterns, and nulls match nothing."""
    if ast is None:
        return F.lit(False)
    if ast[0] == "term":
        hits = [F.coalesce(F.contains(F.lower(t), F.lit(ast[1])), F.lit(False)) for t in texts]
        return _fold(hits, lambda a, b: a | b)
    if ast[0] == "not":
        return ~predicate(ast[1], *texts)
    return _fold([predicate(x, *texts) for x in ast[1]], (lambda a, b: a & b) if ast[0] == "and" else (lambda a, b: a | b))


def _fold(parts: list[Column], both) -> Column:
    """A balanced tree, so that long queries don't nest deeply."""
    while len(parts) > 1:
        parts = [both(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def search(docs: DataFrame, query: str | None, *texts: str) -> DataFrame:
    return docs.filter(predicate(parse(query), *[F.col(t) for t in texts or ("text",)]))


def search_with_chunks(docs: DataFrame, chunks: DataFrame, query: str | None, *texts: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """As ``search``, with each document's chunks as further texts; NOT looks at the whole document.

    Chunks are reduced to one flag per term and document before the join.
    """
    ast = parse(query)
    terms = sorted(set(leaves(ast)))
    if not terms:
        return docs.filter(F.lit(False))
    flags = [F.max(F.contains(F.lower(content), F.lit(t))).alias(f"_t{i}") for i, t in enumerate(terms)]
    found = chunks.groupBy(F.col(key).alias("_key")).agg(*flags)
    at = {t: i for i, t in enumerate(terms)}

    def of(node: Ast) -> Column:
        if node[0] == "term":
            return predicate(node, *[F.col(t) for t in texts]) | F.coalesce(F.col(f"_t{at[node[1]]}"), F.lit(False))
        if node[0] == "not":
            return ~of(node[1])
        return _fold([of(x) for x in node[1]], (lambda a, b: a & b) if node[0] == "and" else (lambda a, b: a | b))

    return docs.join(found, F.col(key) == F.col("_key"), "left").filter(of(ast)).select(*docs.columns)


def _joined(ast: Ast, term, signs: dict[str, str]) -> str | None:
    if ast is None or ast[0] == "not":
        return None
    if ast[0] == "term":
        return term(ast[1])
    parts = [_joined(x, term, signs) for x in ast[1]]
    return None if None in parts else f"({signs[ast[0]].join(parts)})"


def to_arxiv(ast: Ast) -> str | None:
    """The query in arXiv's language; None if it has a NOT."""
    return _joined(ast, lambda t: f'all:"{t}"', {"and": " AND ", "or": " OR "})


def to_s2(ast: Ast) -> str | None:
    """The query in Semantic Scholar's bulk language; None if it has a NOT."""
    return _joined(ast, lambda t: f'"{t}"' if " " in t else t, {"and": " ", "or": " | "})


def portable(ast: Ast) -> str | None:
    """The query with plain AND, OR, NOT and quotes."""
    if ast is None:
        return None
    if ast[0] == "term":
        return f'"{ast[1]}"' if " " in ast[1] else ast[1]
    if ast[0] == "not":
        return f"NOT {portable(ast[1])}"
    return "(" + f" {ast[0].upper()} ".join(portable(x) for x in ast[1]) + ")"


#: What each source's own query language is; others get plain words.
DIALECTS = {"pubmed": portable, "europepmc": portable, "openalex": portable, "core": portable, "doaj": portable, "arxiv": to_arxiv, "s2": to_s2}
LONGEST = 1200


def route(query: str, source: str) -> str:
    """The query as a source takes it; plain words where its language can't say it or it is too long."""
    ast = parse(query)
    own = DIALECTS.get(source, lambda _: None)(ast) if looks_boolean(query) else None
    return own if own and len(own) <= LONGEST else " ".join(leaves(ast))


def sub_queries(raw: object) -> list[dict[str, str | None]]:
    """Cleaned facets (kind, text, op); anything else than a list gives none."""
    out: list[dict[str, str | None]] = []
    for x in raw if isinstance(raw, list) else []:
        text = str(x.get("text") or "").strip() if isinstance(x, dict) else ""
        if text:
            kind, op = x.get("kind"), x.get("op")
            if kind in (None, "auto"):
                kind = "boolean" if looks_boolean(text) else "natural"
            out.append({"kind": kind if kind in ("boolean", "natural") else "natural", "text": text, "op": op if op in ("and", "or") else None})
    return out


def strategy_key(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def facet_ids(docs: DataFrame, facets: list, combinator: str = "union", *texts: str, key: str = "doc_id", translate=lambda t: t) -> DataFrame:
    """Ids that match the facets, folded from left to right; a facet's op overrides the combinator.

    ``translate`` turns a natural facet into a boolean query; the text itself stands in if
    it fails.  All facets are one predicate, so the documents are read once.
    """
    whole: Column | None = None
    for x in sub_queries(facets):
        text = x["text"]
        if x["kind"] == "natural":
            try:
                text = translate(text) or text
            except Exception:
                text = x["text"]
        part = predicate(parse(text), *[F.col(t) for t in texts or ("text",)])
        both = (x["op"] or ("and" if combinator == "intersection" else "or")) == "and"
        whole = part if whole is None else whole & part if both else whole | part
    return docs.filter(F.lit(False) if whole is None else whole).select(key).distinct()


def facet_counts(docs: DataFrame, queries: list[str], *texts: str) -> DataFrame:
    """One row (facet, n) for each query, and for their union and intersection, in one pass."""
    hits = [predicate(parse(q), *[F.col(t) for t in texts or ("text",)]) for q in queries]
    named = {f"facet_{i + 1}": h for i, h in enumerate(hits)}
    named |= {"union": _fold(hits, lambda a, b: a | b), "intersection": _fold(hits, lambda a, b: a & b)}
    row = docs.agg(*[F.count_if(h).alias(n) for n, h in named.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("n")) for n in named])).alias("x")).select("x.*")


def evidence_fingerprint(ids: Column, threshold: float, lang: str | None, context: str) -> Column:
    """A key of a set of ids, a threshold, a language (none: fr) and a context."""
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(ids), ","), F.lit(str(threshold)), F.lit(lang or "fr"), F.lit(context)), 256)
