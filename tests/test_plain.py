"""The queries that SQL cannot say, held against plain Python over the smallest tables."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.operators import concepts, graph
from claimweave.plans import contract

SF = "/root/testdata/sf0.001"
P = {name: W.phrases(getattr(W, name)) for name in ("TRAILING_NOISE", "LEADING_FILLER", "LEADING_DISCOURSE", "TITLE_WORDS", "TITLE_NUMBERS", "TRAILING_DISCOURSE", "CONTRACTION_BASES", "CONTRACTION_ENDS", "NEGATIONS", "SCOPE_BREAKS", "NOT_NEGATING")}
EDGES = " \t\r\n\"'.,:|"


def tokens(text):
    return re.findall(W.TOKEN, text.lower())


def content(text):
    return [t for t in tokens(text) if t not in {*W.STOP, *W.DISCOURSE, *W.WEAK}]


def squeezed(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


# ---- labels -------------------------------------------------------------------------------

LEADING = rf"(?i)^(?:(?:{P['LEADING_FILLER']})\s+|(?:{P['LEADING_DISCOURSE']})\b[\s,:.-]*|(?:{P['TITLE_WORDS']})\s+(?:\d+|{P['TITLE_NUMBERS']})\b[\s:.-]*)+"


def plain_label(cleaned):
    """P7 from text that clean() has been over."""
    text = cleaned
    if ":" in text:
        parts = [re.sub(LEADING, "", p.strip(EDGES[:-1])).strip(" ") for p in text.split(":")]
        fits = sorted((len(p), p) for p in parts if p and content(p) and set(content(p)) <= set(content(text)) and len(p) < len(text))
        text = fits[0][1] if fits else text
    text = re.sub(LEADING, "", text).strip(" ")
    text = re.sub(rf"(?i)\s+(?:{P['TRAILING_DISCOURSE']})\b[\s,:.-]*$", " ", text).strip(" ")
    text = re.sub(r"\s*[\[(][^\])]*$", " ", text).strip(" ")
    for _ in range(2):
        text = re.sub(r"(?i)\b(\w+(?:\s+\w+){0,3})\s+\1\b", r"\1", text)
    return squeezed(text)[:72].strip(" ")


def plain_usable(raw, name):
    """P8 of a label that came from the raw text."""
    low, all_, few, good = name.lower(), tokens(name), [t for t in tokens(name) if t not in W.STOP], content(name)
    amount = low in W.AMOUNT_LABELS
    aux, sub = set(all_) & set(W.AUXILIARY), set(all_) & set(W.SUBORDINATE)
    bad = [
        (tokens(raw) or [""])[0] in W.REJECT_STARTS,
        not name,
        re.search(rf"(?i)\b(?:{P['CONTRACTION_BASES']})'(?:{P['CONTRACTION_ENDS']})\b", name),
        len(all_) >= 3 and ((len(all_) >= 4 and aux) or (sub and aux) or (all_ and all_[0] in W.WEAK and aux)),
        re.search(r"(?i)https?://\S+|www\.\S+|[{}|#]", name),
        low in W.GENERIC,
        (all_ or [""])[0] in W.GENERIC,
        (all_ or [""])[0] in W.AUXILIARY and not amount,
        all_ and not [t for t in all_ if t not in W.TEMPORAL],
        not few,
        not good and not amount,
        len(few) == 1 and few[0] in {*W.DISCOURSE, *W.WEAK},
        (few or [""])[0] in W.DISCOURSE,
        len(few) > 8,
        len(few) == 1 and (len(few[0]) < 3 or few[0].isdigit()),
        sum(c.isalpha() for c in name) < 2,
        len(re.sub(r"[^\W_]|[\s'&./]", "", name)) > max(2, len(name) // 8),
    ]
    return not any(bad)


def test_node_labels(spark):
    raw = contract.link_rows(spark, SF).select("doc_id", "pos", "subject", T.clean(F.col("subject")).alias("cleaned")).collect()
    got = {(r["doc_id"], r["pos"]): r for r in contract.node_labels(spark, SF).collect()}
    assert len(raw) == len(got) > 200
    for r in raw:
        mine = plain_label(r["cleaned"])
        assert got[r["doc_id"], r["pos"]]["label"] == mine, r
        assert got[r["doc_id"], r["pos"]]["usable"] == plain_usable(r["subject"], mine), r


def test_coordinated_parts(spark):
    raw = contract.link_rows(spark, SF).select("doc_id", "pos", T.clean(F.col("subject")).alias("cleaned")).collect()
    wanted = []
    for r in raw:
        name = plain_label(r["cleaned"])
        parts = [plain_label(p.strip(EDGES)) for p in re.split(r"(?i)\s*(?:;|,\s*(?:and|or)\s+|,\s*|\s+\b(?:and|or)\b\s+)\s*", name)]
        some, seen = [], set()
        for p in parts:
            if plain_usable(p, p) and p.lower() not in seen:
                seen.add(p.lower())
                some.append(p)
        some = some[:4] or ([name] if plain_usable(name, name) else [])
        wanted += [(r["doc_id"], r["pos"], p) for p in some]
    assert sorted(map(tuple, contract.coordinated_parts(spark, SF).collect())) == sorted(wanted)


# ---- truth --------------------------------------------------------------------------------


def plain_truth(text, rel):
    """F10 by positions: a negation, the gap to the relation, and what may not stand in between."""
    neg = rf"\b(?:{P['NEGATIONS']})\b"
    if not text:
        return 1
    at = re.search(rf"\b{re.escape(rel)}\b", text) if rel else None
    if not at:
        return 0 if re.search(neg, text) else 1
    start, end = at.span()
    before, after = text[:start], text[end:]

    def open_gap(part, a, b):
        """No comma, no scope break that begins between a and b, at most 72 characters."""
        return b - a <= 72 and not re.search("[,;:]", part[a:b]) and not any(a <= m.start() < b for m in re.finditer(rf"\b(?:{P['SCOPE_BREAKS']})\b", part))

    words_before = [m for m in re.finditer(neg, before)] + [m for m in re.finditer(r"\bwithout\b", before)]
    if any(open_gap(before, m.end(), len(before)) for m in words_before) or any(open_gap(after, 0, m.start()) for m in re.finditer(neg, after)):
        return 0
    if re.search(neg, rel) or rel in W.NEGATIVE_RELATIONS:
        return 0
    return 0 if rel in W.LINKING_NEGATIONS and any(open_gap(after, 0, m.start()) for m in re.finditer(r"\bwithout\b", after)) else 1


def test_truth_flag(spark):
    made = [(f"{a} {r} {b}", r) for a in ("the plan", "no plan", "never, he said, the plan", "the plan without money however") for r in ("is", "lacks", "has") for b in ("good", "not good", "without risk", "a cost, not a gain", "good but never cheap")]
    extra = spark.createDataFrame(made, "sentence string, relation string")
    rows = contract.link_rows(spark, SF).select("sentence", "relation").unionByName(extra)
    said = T.squeezed(T.sub(F.lower(T.clean(F.col("sentence"))), rf"\b(?:{P['NOT_NEGATING']})\b"))
    out = rows.select(said.alias("text"), F.lower(T.clean_part(F.col("relation"))).alias("rel"), T.truth(F.col("sentence"), F.col("relation")).alias("truth")).collect()
    assert all(r["truth"] == plain_truth(r["text"], r["rel"]) for r in out)
    assert {r["truth"] for r in out} == {0, 1}
    assert contract.truth_flag(spark, SF).count() == contract.link_rows(spark, SF).count()


# ---- merges and concepts ------------------------------------------------------------------


def test_compatible_merge(spark):
    state = ["s_quant", "p_quant", "tense", "truth"]
    exact = defaultdict(lambda: [0, 10**18])
    for r in contract.state_claims(spark, SF).collect():
        one = exact[tuple(r[c] for c in ["s", "rel", "o", *state])]
        one[0], one[1] = one[0] + 1, min(one[1], r["ord"])
    buckets = defaultdict(list)
    for key, (n, at) in sorted(exact.items(), key=lambda x: x[1][1]):
        rows = buckets[key[:3]]
        agree = [r for r in rows if all(x == y or "unknown" in (x, y) for x, y in zip(r[0], key[3:], strict=True))]
        if not agree:
            rows.append([list(key[3:]), n, at])
            continue
        known = lambda r: sum(x != "unknown" for x in r[0])
        into = sorted(agree, key=lambda r: (-known(r), r[2]))[0]
        into[0] = [y if x == "unknown" else x for x, y in zip(into[0], key[3:], strict=True)]
        into[1] += n
    wanted = sorted((*k, *map(str, s), n, at) for k, rows in buckets.items() for s, n, at in rows)
    got = sorted((r["s"], r["rel"], r["o"], *(str(r[c]) for c in state), r["n_claims"], r["ord"]) for r in contract.compatible_merge(spark, SF).collect())
    assert got == wanted and sum(r[-2] for r in got) > len(got) > 100


def plain_vector(name, dimensions=256):
    padded = f"  {squeezed(name).lower()}  "
    v = np.zeros(dimensions)
    for i in range(len(padded) - 2):
        v[xxhash.xxh64_intdigest(padded[i : i + 3].encode(), 42) % dimensions] += 1
    return v / max(np.sqrt(v @ v), 1e-9)


@pytest.mark.parametrize("variants", [False, True])
def test_concept_resolution(spark, variants):
    part = spark.read.parquet(f"{SF}/part.parquet")
    names = sorted({r[0] for r in part.select("p_type").collect()} | {r[0] for r in part.select("p_brand").collect()})
    names += [f"the {n.lower()} plating company of the old town" for n in names[:40]] + [f"a {n.lower()} plating company of the old towns" for n in names[:40]] if variants else []
    norm = {n.lower(): n for n in reversed(names)}
    keys, vectors = {}, {}
    for low, name in norm.items():
        v = vectors[low] = plain_vector(name)
        strongest = sorted(range(256), key=lambda i: (-abs(v[i]), i))[:8]
        keys[low] = {f"t{t}" for t in [t for t in tokens(name) if len(t) > 2][:6]} | {(i, v[i] > 0) for i in strongest if v[i]}
    need = lambda v: 0.84 + 0.13 * min(1.0, 0.8 * np.linalg.norm(v) / (1 + np.linalg.norm(v)) + 0.2 * float((v == 0).mean()))
    root = {n: n for n in norm}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in norm:
        for b in norm:
            if a < b and keys[a] & keys[b] and vectors[a] @ vectors[b] >= min(need(vectors[a]), need(vectors[b])) - 1e-12:
                root[find(b)] = find(a)
    groups = defaultdict(list)
    for n in norm:
        groups[find(n)].append(n)
    best = {r: max(ns, key=lambda n: (len(content(norm[n])), -len(norm[n]), norm[n])) for r, ns in groups.items()}
    resolved = concepts.resolve(spark.createDataFrame([(n,) for n in names], "name string")) if variants else contract.concept_resolution(spark, SF)
    got = {r["norm"]: (r["canonical"], r["merge_count"]) for r in resolved.collect()}
    assert got == {n: (norm[best[find(n)]], len(groups[find(n)])) for n in norm}
    assert (max(len(g) for g in groups.values()) > 1) == variants


# ---- walks, layout, claims ----------------------------------------------------------------


def test_seeded_walks(spark):
    edges = defaultdict(set)
    for r in contract.structured_edges(spark, SF).select("s", "o").collect():
        edges[r["s"]].add(r["o"])
    rows = contract.seeded_walks(spark, SF).collect()
    assert len(rows) == 64 and sorted(r["walk_id"] for r in rows) == list(range(64))
    for r in rows:
        path = r["path"].split(">")
        assert path[0] == r["seed"] and all(b in edges[a] for a, b in zip(path, path[1:], strict=False))
        assert r["reason"] == "endpoint" and path[-1] == r["goal"] and r["goal"] not in path[:-1]
    assert len({r["path"] for r in rows}) > 20


def plain_frames(position, velocity, springs, frames):
    """G10 with loops over nodes and springs."""
    p, v = [list(x) for x in position], [list(x) for x in velocity]
    bound = 520 + 30 * len(p) ** 0.5
    for _ in range(frames):
        force = [[0.0] * 3 for _ in p]
        for a, b, u in springs:
            gap = [p[b][k] - p[a][k] for k in range(3)]
            far = max(sum(g * g for g in gap) ** 0.5, 1e-6)
            pull = max(-3.25, min(3.25, (0.014 + 0.061 * u * u) * (far - (33.6 - 21 * u)))) * 0.035 / far
            for k in range(3):
                force[a][k] += pull * gap[k]
                force[b][k] -= pull * gap[k]
        for i in range(len(p)):
            r = sum(x * x for x in p[i]) ** 0.5
            for k in range(3):
                if r > bound:
                    force[i][k] -= (r - bound) * 0.01 / max(r, 1e-6) * p[i][k]
                v[i][k] = (v[i][k] + force[i][k]) * 0.94
        for i in range(len(p)):
            for k in range(3):
                p[i][k] += v[i][k]
    return np.array(p)


def test_force_layout(spark):
    rng = np.random.default_rng(1)
    at, speed = rng.normal(0, 400, (9, 3)), rng.uniform(-0.035, 0.035, (9, 3))
    springs = [(int(a), int(b), float(u)) for a, b, u in zip(rng.integers(0, 9, 14), rng.integers(0, 9, 14), rng.uniform(0, 1, 14), strict=True)]
    s, o, u = (np.array(x) for x in zip(*springs, strict=True))
    moved, frames, _ = graph.relax(at, speed, s, o, u, 60)
    assert frames == 60 and np.allclose(moved, plain_frames(at, speed, springs, 60))
    rows = contract.force_layout(spark, SF).collect()
    assert len(rows) == 30 and len({r["node"] for r in rows}) == 30 and len({r["frames"] for r in rows}) == 1  # 25 nations, 5 regions
    assert all(np.isfinite([r["x"], r["y"], r["z"]]).all() for r in rows)


def test_extracted_claims(spark):
    rows = contract.extracted_claims(spark, SF).collect()
    assert len(rows) > 100
    assert all(plain_usable(r["subject"], r["subject"]) and plain_usable(r["predicate"], r["predicate"]) for r in rows)
    assert all(r["subject"].lower() != r["predicate"].lower() and r["truth"] in (0, 1) and r["tense"] in ("past", "present", "future") for r in rows)
    linking = {(r["doc_id"], r["pos"]) for r in contract.link_rows(spark, SF).collect()}
    assert linking  # claims of the linking pattern name one of its verbs
    assert {r["relation"] for r in rows} & set(W.LINKING_PHRASES)


# ---- operators without a query ------------------------------------------------------------


def test_stored_concepts_survive_calls(spark, tmp_path):
    path = str(tmp_path / "concepts")
    label = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    first = {r["norm"]: r["concept_id"] for r in concepts.stored_concepts(spark, label("rent control", "urban sprawl", "traffic"), path).collect()}
    second = {r["norm"]: r["concept_id"] for r in concepts.stored_concepts(spark, label("Rent  Control", "rent controls", "a glacier"), path).collect()}
    assert first.items() <= second.items() and len(second) == 5 and second["a glacier"] not in first.values()


def test_refine_takes_near_labels_and_makes_no_nodes(spark):
    nodes = spark.createDataFrame([("rent control",), ("urban sprawl",)], "label string")
    claims = spark.createDataFrame([("Rent control", "is", "urban sprawl"), ("rent control", "is", "a volcano"), ("rent control", "is", "Rent  control"), ("the rent control", "has", "urban sprawl")], "subject string, relation string, predicate string")
    near = lambda c: F.when(F.lower(c).contains("rent"), F.array(F.lit(1.0), F.lit(0.0))).when(F.lower(c).contains("urban"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.7), F.lit(-0.7)))
    got = sorted(map(tuple, concepts.refine(nodes, claims, near).collect()))
    assert got == [("rent control", "has", "urban sprawl"), ("rent control", "is", "urban sprawl")]


def test_semantic_negation_with_a_real_embedder(spark):
    meaning = {"unavailable": [1.0, 0.1], "interest": [0.0, 1.0], "unable": [1.0, 0.0], "hopeless": [0.9, 0.2]}
    base = F.array(F.lit(-1.0), F.lit(0.0))

    def embed(c):
        out = base
        for w, v in meaning.items():
            out = F.when(c == w, F.array(*map(F.lit, v))).otherwise(out)
        return out

    rows = spark.createDataFrame([("the service is unavailable", "is"), ("the interest is high", "is"), ("a hopeless case was filed", "was"), (None, None)], "clause string, relation string")
    got = [r["v"] for r in rows.select(concepts.semantic_negation(F.col("clause"), F.col("relation"), embed).alias("v")).collect()]
    assert got == [True, False, True, False]


@pytest.mark.parametrize("limit", [None, 64])
def test_reachability_has_no_end_of_its_own(spark, limit):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(90)], "s string, o string")
    start = spark.createDataFrame([(0, "n0")], "origin int, node string")
    if limit:
        with pytest.raises(RuntimeError):
            graph.reachable(edges, start, max_rounds=limit)
    else:
        assert graph.reachable(edges, start).count() == 91


def test_states_ends_and_display(spark):
    e = spark.createDataFrame([(1, "a", "b", None, "one"), (2, "b", "c", "all", None)], "edge_id long, s string, o string, s_quant string, p_quant string").withColumns({"tense": F.lit("past"), "truth": F.lit(1)})
    packed = spark.createDataFrame([(1, "some", "many", "present", 0), (2, "x", "few", "present", 0)], "edge_id long, s_quant string, p_quant string, tense string, truth int")
    assert sorted((r["edge_id"], r["s_quant"], r["p_quant"], r["tense"]) for r in graph.edge_states(e, packed).collect()) == [(1, "some", "one", "past"), (2, "all", "few", "past")]
    at = e.select("edge_id", graph.endpoint_of(F.lit("b"), F.col("s_quant"), F.col("p_quant")).alias("x"), graph.endpoint_of(F.lit("z")).alias("z")).collect()
    assert {r["edge_id"]: r["x"] for r in at} == {1: "one", 2: "all"} and {r["z"] for r in at} == {None}
    shown = spark.sql("select array(named_struct('text', ' Two  parts'), named_struct('text', 'two parts'), named_struct('text', ''), named_struct('text', '1999')) as v").select(T.format_specifics(F.col("v")).alias("t")).first()["t"]
    assert shown == "Two parts; 1999"


def test_pages_are_fetched_and_failures_told(spark):
    from claimweave.sources import blocks, search

    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("no route")
        return f"<html><head><style>x</style></head><body><nav>menu</nav><article><h1>Title</h1><p>Some &amp; text</p><form>ask</form></article><footer>foot</footer></body></html><!-- {url} -->"

    hits = spark.createDataFrame([("q", 0, "https://a.org/x"), ("q", 1, "https://bad.org"), ("q", 2, None)], "query string, ord int, url string")
    rows = {r["ord"]: r for r in search.fetched_pages(hits, fetch).select("*", blocks.main_text(F.col("html")).alias("text")).collect()}
    assert rows[0]["text"] == "Title Some & text" and rows[0]["error"] is None
    assert rows[1]["html"] is None and rows[1]["error"] == "OSError: no route" and rows[2]["error"] is None
    assert search.parse_hits("q", "{}")[0][-1]


def test_long_blocks_are_cut_into_successive_ones(spark):
    from claimweave.sources import blocks

    text = " ".join(f"word{i}" for i in range(1500)) + " " + "x" * 5000
    one = spark.createDataFrame([(1, 2, "", "s", text)], "block_id long, ord long, url string, source string, content string")
    got = [r["content"] for r in blocks.limited_blocks(one).orderBy("ord").collect()]
    assert all(len(c) <= 2400 for c in got) and " ".join(got).replace(" ", "") == text.replace(" ", "")


def plain_segment(page):
    """S4 by trying every stretch of a page's tags and runs of text."""
    import re

    from claimweave.sources import blocks

    tokens = re.findall(r"<[^>]*>|[^<]+", re.sub(blocks.UNREAD, " ", page or ""))
    score, shown, named, aside, inside = [], [], [], 0, 0
    for t in tokens:
        name = re.match(blocks.TAG_NAME, t)
        name = name[1].lower() if name else ""
        turn = 0 if not name else -1 if t.startswith("</") else 1
        aside += turn if name in blocks.NESTING else 0
        inside += turn if name in blocks.NAMED else 0
        words = len(t.split()) if not name and aside <= 0 else 0
        cost = blocks.ASIDE_COST if name in blocks.NESTING else 0 if aside > 0 and not name else blocks.LINK_COST if name == "a" else 0 if not name or name in blocks.INLINE else blocks.TAG_COST
        score.append(words - cost)
        shown.append("" if name == "a" or name in blocks.INLINE else " " if name or aside > 0 or t.startswith("<") else t)
        named.append((inside > 0, words))
    best = max(((sum(score[i : j + 1]), -j, i) for j in range(len(tokens)) for i in range(j + 1)), default=(0, 0, 0))
    best = max(((g, j, -i) for g, j, i in [best]), default=None) if best[0] > 0 else None
    stretch = ""
    if best:
        gain, j = best[0], -best[1]
        i = min(i for i in range(j + 1) if sum(score[i : j + 1]) == gain)
        stretch = "".join(shown[i : j + 1])
    clean = lambda s: " ".join(s.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").split())
    text = "".join(s for s, (n, _) in zip(shown, named, strict=True) if n) if any(n and w for n, w in named) else stretch
    return clean(text), clean(stretch)


def test_main_segments_of_nested_pages(spark):
    from claimweave.sources import blocks

    words = lambda n, w="word": " ".join([w] * n)
    pages = [
        f"<div><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></div><div><p>{words(30)}</p><p>short</p><div><p>{words(20, 'more')}</p></div></div><div>fin</div>",
        f"<article><div>a<b>b</b> &lt;c</div><nav>x<nav>y</nav>z</nav><table><tr><td>{words(40)}<table><tr><td>in</table></table><p>tail</article><p>{words(50)}",
        f"<main><article>one</article></main>{words(9)}",
        "",
        None,
        "<nav>only</nav>",
        f"<script>if (a < b) {{ x }}</script>{words(3)} <aside>{words(99)}</aside> end of it all",
        words(5) + " <p>" + words(2) + "</p>" + words(5),
    ]
    got = {r["page_id"]: (r["text"], r["segment"]) for r in blocks.main_segments(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()}
    assert got == {i: plain_segment(p) for i, p in enumerate(pages)}
    assert got[0][0] == f"{words(30)} short {words(20, 'more')}" and got[1][0] == "ab <c tail"


def test_cached_claims_are_those_of_the_blocks(spark, monkeypatch):
    """The same claims with a cache, empty blocks known too; another version is extracted anew."""
    import uuid

    from claimweave.operators import extract

    said = ["Rent control is a price ceiling. A price ceiling is a cause.", "Nothing here", "Urban sprawl is a commute problem; rent control was a law in 1974.", "Rent control is a price ceiling. Traffic is a cost.", ""]
    block = lambda rows: spark.createDataFrame([(i, i, "", src, t) for i, (src, t) in enumerate(rows)], "block_id long, ord long, url string, source string, content string")
    blocks = block([("doc|a.org", t) for t in said] + [("doc|b.org", said[0])])
    plain = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(r.asDict()) if c != "block_id") for r in df.collect())))
    want, name = plain(extract.claims(blocks)), uuid.uuid4().hex
    asked = []
    whole = extract.claims
    monkeypatch.setattr(extract, "claims", lambda b, **more: asked.append(b.count()) or whole(b, **more))
    assert plain(extract.cached_claims(spark, block([("doc|a.org", said[3])]), name)) != want
    assert plain(extract.cached_claims(spark, blocks, name)) == want
    assert plain(extract.cached_claims(spark, blocks, name)) == want
    assert plain(extract.cached_claims(spark, blocks, name, version="2")) == want
    assert asked == [1, 4, 0, 5]
