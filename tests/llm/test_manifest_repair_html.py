"""Merkle manifest, conversation repair and main text against plain Python, and on odd rows."""

import hashlib
import heapq
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import html_text, merkle, oracles, queries, repair
from tests.llm.conftest import COLUMNS

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    return sha(*[said(row[c] if c != "n_chars" or row[c] is None else row[c] + more) for c in merkle.FIELDS])


def levels_of(nodes, run):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + run]) for i in range(0, len(out[-1]), run)])
    return out


def path_of(levels, i, run):
    out = []
    for level in levels[:-1]:
        first = i // run * run
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + run])))
        i //= run
    return out


def plain_proofs(rows, run):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {k: levels_of([leaf_of(r) for r in groups[k]], run) for k in order}
    top = levels_of([trees[k][-1][0] for k in order], run)
    out = []
    for at, k in enumerate(order):
        for i, r in enumerate(groups[k]):
            path = path_of(trees[k], i, run) + path_of(top, at, run)
            now = leaf_of(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for before, after in path:
                now = sha(before, now, after)
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], sha(*[a + b for a, b in path]), now, now == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def as_rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("run", "tier"), [(2, 8), (2, 2), (3, 1)])
def test_proofs_equal_plain_trees(spark, some_docs, run, tier):
    docs = some_docs.limit(61)  # a fixture: trees of odd sizes, several tiers
    rows = [r.asDict() for r in docs.collect()]
    assert as_rows(merkle.proofs(spark.createDataFrame(rows, docs.schema), run, tier), NAMES) == plain_proofs(rows, run)


def test_proofs_of_odd_rows(edge_docs, odd_docs, no_docs):
    rows = [r.asDict() for r in edge_docs.collect()]
    want = plain_proofs(rows, 2)
    assert as_rows(merkle.proofs(edge_docs), NAMES) == want
    clash = odd_docs.withColumn("leaf", F.lit("mine")).withColumn("tree", F.create_map(F.lit("a"), F.lit(1)))
    assert as_rows(merkle.proofs(clash), NAMES) == want
    assert merkle.proofs(no_docs).count() == 0


def test_one_tree_and_one_leaf(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], COLUMNS)
    one = merkle.proofs(docs).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha()
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert as_rows(merkle.proofs(many), NAMES) == plain_proofs([r.asDict() for r in many.collect()], 2)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair", "op13_html_extraction"])
def test_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    other = duck.sql(queries.oracle_sql()[name])
    assert as_rows(queries.queries()[name](spark, SF), other.columns) == sorted(other.fetchall(), key=repr)
    assert duck.sql(f"select {oracles.crc32('x')} from (values ('123456789'), ('0')) t(x)").fetchall() == [(zlib.crc32(b"123456789"),), (zlib.crc32(b"0"),)]


def plain_repair(rows, insert=5):
    """Search over (cost, edits) in order of both, one conversation at a time."""
    chats = {}
    for conv, turn, role, text, gone in rows:
        own = chats.setdefault(conv, [])
        if not gone:
            own.append((turn, role, text))
    out = []
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    for conv, own in chats.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, talk = heapq.heappop(heap)
            if i == len(own) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            due = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[due]
            heapq.heappush(heap, (cost + insert, audit + "I", i, due, (*talk, f"{name}:")))
            if i < len(own):
                _, role, text = own[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, talk))
                if faults[i] not in ("blank", "duplicate"):
                    stays = 5 if faults[i] == "truncated" else 0
                    if role[:1] in moves[state]:
                        heapq.heappush(heap, (cost + stays, audit + "K", i + 1, moves[state][role[:1]], (*talk, f"{role}:{text}")))
                    heapq.heappush(heap, (cost + stays + 1, audit + "R", i + 1, due, (*talk, f"{name}:{text}")))
        initials = [r[:1] for _, r, _ in own]
        out.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                cost,
                audit,
                hashlib.sha256("\n".join(talk).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


REPAIRED = ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
DAMAGED = "conv_id long, turn long, role string, text string, gone boolean"


def random_chats(seed, many):
    import random

    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", "unknown", "User"], ["Yes.", "No!", "cut", " \t", "", "Why? ", "é."]
    rows = []
    for conv in range(many):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv if conv else None, rng.choice([turn, turn, 7, None]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts) + rng.choice(["", f"{turn}."]), rng.random() < 0.1))
    return rows


def test_repair_equals_search(spark):
    rows = random_chats(3, 400)
    got = as_rows(repair.repair(spark.createDataFrame(rows, DAMAGED)), REPAIRED)
    assert got == plain_repair(rows)
    assert {"D", "K", "R"} == set("".join(r[7] for r in got))


def test_inserts_where_they_are_cheap(monkeypatch):
    """At the real costs a turn put in never pays, as one deleted mends the order too."""
    monkeypatch.setattr(repair, "INSERT", 1)
    rows = [r for r in random_chats(5, 300) if r[0] is not None and not r[4] and r[3].strip()]
    want = plain_repair(rows, insert=1)
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    lengths = np.array([len(by[r[0]]) for r in want])
    every = [x for r in want for x in sorted(by[r[0]])]
    seen, again = set(), []
    for conv, x in ((r[0], x) for r in want for x in sorted(by[r[0]])):
        again.append((conv, x[2:]) in seen)
        seen.add((conv, x[2:]))
    initial = np.array(["sua".find(x[2][:1]) if x[2][:1] and x[2][0] in "sua" else 3 for x in every])
    cut = np.array([x[3].strip()[-1] not in ".!?" for x in every]) & ~np.array(again)
    cost, audit = repair.repaired(lengths, np.cumsum(lengths) - lengths, initial, np.array(again), cut)
    assert list(zip(cost, audit, strict=True)) == [(r[6], r[7]) for r in want] and any("I" in a for a in audit)


def test_repair_cuts_batches_anywhere(spark, monkeypatch):
    rows = random_chats(4, 60)
    frame = spark.createDataFrame(rows, DAMAGED).repartition(1)
    monkeypatch.setattr(repair, "BATCH_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert as_rows(repair.repair(frame), REPAIRED) == plain_repair(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_of_a_long_conversation_and_odd_tables(spark):
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 97 else "", False) for t in range(5000)] + [(2, 0, "user", "x" * 200000 + ".", False)]
    assert as_rows(repair.repair(spark.createDataFrame(long, DAMAGED)), REPAIRED) == plain_repair(long)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(empty)).count() == 0
    rows = [(None, None, None, None), (6, None, "user", None), (6, 1, None, "a."), (6, 1, None, "a.")]
    nulls = spark.createDataFrame(rows, empty.schema).withColumn("audit", F.lit("mine"))
    fates = [zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20 for r in rows]
    want = plain_repair([(r[0], r[1], r[2] or " ", r[3] or " ", f == 0) for r, f in zip(rows, fates, strict=True)])
    assert all(f > 4 for f in fates[1:]) and as_rows(repair.repair(repair.damaged(nulls)), REPAIRED) == want


P = [" ".join([f"Words of story number {n}, which goes on for a while and tells things."] * 4) for n in range(10)]
PAGES = [
    # nothing is named: the density decides
    (f'<body><div id=top><a href=/>Home</a> <a href=/b>More</a></div><div><div><h1>Title</h1><p>{P[1]}</p><p>Short.</p><div><p>{P[2]}</p><p>{P[3]}</p></div></div></div><div><a href=/c>Terms</a> © us</div>', f"Title {P[1]} Short. {P[2]} {P[3]}"),
    # comments may outweigh the article
    (f'<div id="page" class="has-sidebar"><div class="post"><h1>T</h1><p>{P[1]}</p></div><div class="sidebar"><p>{P[4]}</p></div></div><section id="comments"><article><p>{P[5] * 3}</p></article></section>', f"T {P[1]}"),
    # named, with all that isn't its text
    (
        f'<body><header><h1>Site</h1></header><main><article><header><h1>T &amp; U</h1></header><p>a<b>b</b>c &lt;x&gt; d<br>e</p><aside>{P[6]}</aside><div class="ad-slot">buy</div><p>tail<!-- x -->end</p>'
        f"<form><input><p>mail</p></form><footer>by me</footer></article></main><div class='related'><article>{P[7]}</article></div><footer>f</footer>",
        "T & U abc <x> d e tailend",
    ),
    (f'<div class="cookie-notice"><p>{P[5]}</p></div><div class="content"><p>Tiny text.</p></div>', "Tiny text."),
    (f"<form id=whole><div><h1>H</h1><p>{P[1]}</p><input type=text></div></form>", f"H {P[1]}"),
    ('<p>one<p>two <a href="x>y">three</a> <script>if(a<b){"</p>"}</script>four', "one two three four"),
    ("<table><tr><td>one<td>two<tr><td>three</table>", "one two three"),
    ("<article><p>a<nav>b<p>c</nav>d &nbsp; e\n\tf</article", "a d e f"),
    ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"),
    ("<article><p title=\"x>unclosed 'q</p></article>", "unclosed 'q"),  # where the page holds no second quote
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav><script>x</script>", ""),
]


def test_main_text_of_pages(spark, no_docs):
    rows = [(n, f"http://x/{n}", page, "mine") for n, (page, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(frame).collect()}
    for n, (_, want) in enumerate(PAGES):
        assert got[n] == (want, len(want)), n
    assert html_text.extract_pages(frame).count() == len(rows)
    assert html_text.extract_pages(frame.where("false")).count() == 0


def test_main_text_of_many_random_articles():
    import random

    rng = random.Random(13)
    words = "the of Étion &amp; &lt;b&gt; 3 &#233;t. naïve, ünd &nbsp; end.".split()
    for _ in range(200):
        paragraphs = [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 200]))) for _ in range(rng.randrange(1, 8))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<ul><li>{}</ul>", "<section><h2>x</h2>{}</section>", "<blockquote>{}</blockquote>"]).format(p) for p in paragraphs)
        body_text = re.sub(r"<[^>]*>", " ", body)
        page = f"<html><head><title>t</title><style>p</style></head><body><nav><ul><li><a href=/>m</a></ul></nav><div class='ad'>{'buy ' * 300}</div><article>{body}</article><section class=comments><p>{'no ' * 500}</section><footer>f</footer>"
        assert html_text.main_text(page) == " ".join(html.unescape(body_text).split())


def test_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html_text.main_text("<article>" + "<p>word " * 100_000 + "</article>").split()) == 100_000
    html_text.main_text('<a title="' * 20_000)
    assert time.perf_counter() - began < 60
