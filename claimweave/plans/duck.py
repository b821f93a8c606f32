"""The text operators once more as DuckDB SQL strings: the oracle side of the contract queries."""

from __future__ import annotations

from claimweave.functions import words as W


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(q, sorted(set(values)))) + "]"


def clean(x: str) -> str:
    t = f"translate(coalesce({x}, ''), '‘’“”–—', '''''\"\"--')"
    for pattern in (
        r"<[^>]+>",
        r"(?i)https?://\S+|www\.\S+",
        r"(?i)\[(?:\d+|citation needed|edit|note \d+)\]",
        r"(?i)\((?:PDF|video|audio|archived|retrieved[^)]*)\)",
        rf"(?i)[\s.·|]*(?:{W.phrases(W.NAVIGATION)})\b.*$",
        r"\\[a-zA-Z]+\{[^}]*\}",
        r"[_*`~]+",
        r"\s+",
        r"\s*-\s*",
    ):
        t = sub(t, pattern)
    return f"trim({t}, ' ' || chr(9) || chr(13) || chr(10) || '\"''.,:|')"


def clause(x: str) -> str:
    """clean_clause of an expression that is evaluated once."""
    n = W.LIMITS["clause_chars"]
    return (
        f"list_transform([{clean(x)}], lambda b: list_transform([trim(case when length(b) <= {n} then b when regexp_extract(b, {q(rf'^(.{{80,{n}}}?[.!?])\s')}, 1) <> '' "
        f"then regexp_extract(b, {q(rf'^(.{{80,{n}}}?[.!?])\s')}, 1) else left(b, {n}) end, ' ,:')], lambda c: case when c = '' then '' when regexp_matches(c, '[.!?]$') then c else c || '.' end)[1])[1]"
    )


def split_clean(x: str, pattern: str, by: str) -> str:
    marked = f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace({clause('s')}, '[.!?]+$', '')), lambda s: s <> '')"


def sentences(x: str) -> str:
    return split_clean(clean(x), r"([.!?])\s+", "'\\1' || chr(1)")


def clauses(x: str) -> str:
    c = W.phrases(W.CLAUSE_COORDINATORS)
    return split_clean(x, rf"(?i)\s*(?:;|,\s+(?:{c})\s+|\s+\b(?:{c})\b\s+)\s*", "chr(1)")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(W.TOKEN)})"


def without(x: str, *lists: list[str]) -> str:
    return f"list_filter({x}, lambda t: not list_contains({listed([w for v in lists for w in v])}, t))"


def stem(t: str) -> str:
    ok = lambda s: f"(length({s}) >= 4 and regexp_matches({s}, '[aeiouy]') and regexp_matches({s}, '[bcdfghjklmnpqrstvwxyz]'))"
    out = ["case"]
    for suffix in W.DERIVATIONAL:
        cut = f"regexp_replace({t}, '{suffix}$', '')"
        out.append(f"when regexp_matches({t}, '{suffix}$') and {ok(cut)} then {cut}")
    cut = f"regexp_replace({t}, 'ing$', '')"
    twice = f"(length({cut}) > 1 and {cut}[-1] = {cut}[-2])"
    out.append(f"when regexp_matches({t}, 'ing$') and {ok(cut)} and ({twice} or regexp_matches({t}, '[wlkmnprt]ing$')) then case when {twice} then {cut}[:-2] else {cut} end")
    cut = f"regexp_replace({t}, 'ed$', '')"
    out.append(f"when regexp_matches({t}, 'ed$') and {ok(cut)} then {cut}")
    out.append(f"when regexp_matches({t}, 'ies$') and length({t}) > 4 then regexp_replace({t}, 'ies$', 'y')")
    out.append(f"when regexp_matches({t}, 's$') and length({t}) > 4 then regexp_replace({t}, 's$', '') else {t} end")
    return " ".join(out)


def acronyms(x: str) -> str:
    """Initials of runs of two to four terms of an expression that is evaluated once."""
    stop = listed(W.STOP)
    raw = f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), {q(W.TARGET_TOKEN)}), lambda t: length(t) >= 3 and not list_contains({stop}, t))"
    initials = f"list_transform(list_filter(list_transform({raw}, lambda t: {stem('t')}), lambda t: t <> '' and not list_contains({stop}, t)), lambda t: t[1])"
    runs = ", ".join(f"list_transform(range(1, greatest(1, len(i) - {k} + 2)::bigint), lambda p: array_to_string(i[p:p + {k} - 1], ''))" for k in (2, 3, 4))
    return f"list_transform([{initials}], lambda i: list_filter(list_concat({runs}), lambda a: not list_contains({stop}, a)))[1]"


def ordered_distinct(x: str) -> str:
    return f"list_transform([{x}], lambda l: list_filter(l, lambda t, i: list_position(l, t) = i))[1]"


def target_tokens(x: str, least: int = 3) -> str:
    fits = f"not list_contains({listed(W.STOP)}, t) and (length(t) >= {least} or length(t) = 2)"
    raw = f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), {q(W.TARGET_TOKEN)}), lambda t: {fits})"
    return ordered_distinct(f"list_filter(list_transform({raw}, lambda t: {stem('t')}), lambda t: t <> '' and {fits})")
