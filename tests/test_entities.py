"""Names, overrides, ownership chains and text extraction."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import by
from panelyard.functions import text as X
from panelyard.operators import hierarchy, names

REG = "SEQ int, CIK_STR long, TICKER string, TITLE string"
INST = "CERT string, FED_RSSD long, NAME string"


def test_exact_hit_and_stop_words(frame):
    registry = frame(REG, [(0, 999, "FHN", "First Horizon Corp"), (1, 998, "X", "Bank of the National Trust"), (2, 997, "Y", "First Horizon")])
    inst = frame(INST, [("1", 1, "First Horizon Corporation"), ("2", 2, "National Bank of Nowhere"), ("3", 3, None)])
    got = by(names.sec_mapping(inst, registry), "CERT")
    assert (got["1"]["SEC_CIK"], got["1"]["SEC_MATCH_TYPE"]) == (999, "exact")
    assert got["2"]["SEC_CIK"] is None and got["3"]["SEC_MATCH_TYPE"] is None


def test_holder_name_wins(frame):
    registry = frame(REG, [(0, 42, "T", "Top Holder Inc")])
    inst = frame(INST, [("1", 100, "Small Bank")])
    holders = frame("ID_RSSD long, TOP_HOLDER_NAME string", [(100, "TOP HOLDER, INC.")])
    row = names.sec_mapping(inst, registry, holders=holders).first()
    assert (row["SEC_CIK"], row["SEC_MATCH_TYPE"]) == (42, "exact")


def test_overrides(frame):
    mapping = frame("CERT string, SEC_CIK long, SEC_TICKER string, SEC_TITLE string, SEC_MATCH_TYPE string",
                    [("100", 1, "A", "Title", "exact"), ("200", None, None, None, None)])
    over = frame("CERT string, CIK long, TICKER string", [("100", 7, None), ("300", 8, "Z")])
    got = by(names.manual_override(mapping, over), "CERT")
    assert tuple(got["100"])[1:] is not None and got["100"]["SEC_CIK"] == 7 and got["100"]["SEC_TICKER"] == "A"
    assert got["100"]["SEC_MATCH_TYPE"] == "override" and got["200"]["SEC_CIK"] is None and len(got) == 2


def brute(asked, registered):
    best = None
    for seq, other in registered:
        o = len(asked & other)
        if o >= 2 and o / max(len(asked), len(other)) >= 0.6 and (best is None or o / max(len(asked), len(other)) > best[0]):
            best = (o / max(len(asked), len(other)), seq)
    return best


@pytest.mark.parametrize("longest, words, split", [(6, 9, 64), (6, 9, 25), (14, 18, 100)])
def test_overlap_matches_all_pairs(frame, monkeypatch, longest, words, split):
    """Short and long sets, two words that most names share, and keys that are split several times."""
    monkeypatch.setattr(names, "SPLIT_ROWS", split)
    rng = random.Random(longest)

    def name():
        picked = rng.sample([f"w{i}" for i in range(words)], rng.randint(1, longest - 2))
        return sorted(set(picked + [w for w in ("hot", "warm") if rng.random() < 0.7]))

    registered = [(i, name()) for i in range(120)]
    asked = [name() for _ in range(150)]
    registry = frame(REG, [(i, i, "T", " ".join(n)) for i, n in registered])
    inst = frame(INST, [(str(i), i, " ".join(n)) for i, n in enumerate(asked)]).withColumn("INST_NAME_NORM", F.col("NAME"))
    lookup = names.registry_lookup(registry)
    open_names = inst.withColumns({c: F.lit(None).cast("long" if c == "SEC_CIK" else "string") for c in names.MATCH_COLUMNS})
    got = by(names.token_overlap_match(open_names, lookup), "CERT")
    sets = [(i, set(n)) for i, n in registered]
    hits = 0
    for i, n in enumerate(asked):
        want = brute(set(n), sets)
        row = got[str(i)]
        assert (row["SEC_CIK"], row["SEC_MATCH_TYPE"]) == ((want[1], f"fuzzy_{want[0]:.2f}") if want else (None, None))
        hits += want is not None
    assert hits > 20


def walk(parents, node):
    seen = set()
    while node in parents and node not in seen:
        seen.add(node)
        node = parents[node]
    return node


def test_chain_and_root(frame):
    edges = frame("ID_RSSD_PARENT long, ID_RSSD_OFFSPRING long", [(200, 100), (300, 200)])
    assert {r[0]: r[1] for r in hierarchy.top_holder(edges).collect()} == {100: 300, 200: 300, 300: 300}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_cycles(frame, seed):
    rng = random.Random(seed)
    parents = {i: rng.randrange(60) if rng.random() < 0.3 else rng.randrange(max(i, 1)) if i else 59 for i in range(50)}
    parents |= {100 + i: 101 + i for i in range(20)} | {200: 201, 201: 202, 202: 200, 203: 201, 204: 203}
    edges = frame("ID_RSSD_PARENT long, ID_RSSD_OFFSPRING long, seq int",
                  [(p, c, 1) for c, p in parents.items()] + [(999, c, 0) for c in list(parents)[::7]])
    got = {r[0]: r[1] for r in hierarchy.top_holder(edges, ["seq"]).collect()}
    nodes = set(parents) | set(parents.values())
    assert got == {n: walk(parents, n) for n in nodes}


@pytest.mark.parametrize("html, amount", [
    ("<p>Estimated uninsured deposits of $21.2 billion at year end</p>", 21_200_000.0),
    ("<p>uninsured deposits were approximately known</p><p>Uninsured deposits totaled $1,558.6 million.</p>", 1_558_600.0),
    ("<p>We take deposits.</p>", None),
    ('<ix:nonFraction name="us-gaap:DepositLiabilityUninsured" scale="6">1,234</ix:nonFraction>', 1_234_000.0),
    ('<ix:nonFraction name="us-gaap:DepositLiabilityUninsured" id="a">77</ix:nonFraction>', 77.0)])
def test_amounts(frame, html, amount):
    df = frame("h string", [(html,)])
    row = df.select(*[c.alias(n) for n, c in X.disclosed_amount("h").items()]).first()
    assert row["SEC_UNINSURED_AMOUNT"] == (pytest.approx(amount) if amount else None)
    assert row["SEC_UNINSURED_FOUND"] == (amount is not None)


def test_mentions(frame):
    df = frame("t string", [("Available-for-sale and held to maturity",), ("nothing",)])
    assert [tuple(r) for r in df.select(*X.mention_flags("t").values()).collect()] == [(True, True), (False, False)]


def test_html_text(frame):
    html = "<style>p{}</style><p>A&nbsp;&amp;lt; B &#8364;&#65;</p><!-- x --><script>var a='<p>';</script>\n<b>c</b>d"
    assert frame("h string", [(html,)]).select(X.html_text("h")).first()[0] == "A &lt; B €A c d"


@pytest.mark.parametrize("href, url", [
    ("/x/a.zip", "https://h.org/x/a.zip"), ("b.csv?v=1", "https://h.org/d/b.csv?v=1"), ("../c.txt", "https://h.org/c.txt"),
    ("./e/./f", "https://h.org/d/e/f"), ("//o.net/q", "https://o.net/q"), ("http://z/y", "http://z/y"), ("?p=2", "https://h.org/d/page?p=2"),
    ("#top", "https://h.org/d/page#top"), ("../../../g", "https://h.org/g")])
def test_absolute_url(frame, href, url):
    df = frame("b string, h string", [("https://h.org/d/page", href)])
    assert df.select(X.absolute_url("b", "h")).first()[0] == url


def test_links(frame):
    html = ('<a href="/a.zip">One <b>file</b></a><A class="x" HREF=\'b.CSV\'></A><a href="/a.zip">again</a><a name="n">no</a>'
            '<a href="c.html">page</a>')
    pages = frame("page_id int, url string, html string", [(1, "https://h.org/d/", html)])
    got = [tuple(r) for r in X.link_extract(pages, (".zip", ".csv")).orderBy("POSITION").collect()]
    assert got == [(1, 0, "One file", "https://h.org/a.zip"), (1, 1, "b.CSV", "https://h.org/d/b.CSV")]
    assert X.link_extract(pages, match=["one", "zip"]).count() == 1


def test_overlap_sends_no_sets_through_the_driver(frame, spark):
    """Word sets of all rounds are joined by merging, whatever their written size, and a name is normalised in many tasks."""
    registry = frame(REG, [(i, i, "T", f"alpha beta{i % 9} gamma") for i in range(30)])
    inst = frame(INST, [(str(i), i, f"alpha beta{i} delta gamma") for i in range(12)]).withColumn("INST_NAME_NORM", F.col("NAME"))
    lookup = names.registry_lookup(registry)
    assert lookup.rdd.getNumPartitions() > 1
    open_names = inst.withColumns({c: F.lit(None).cast("long" if c == "SEC_CIK" else "string") for c in names.MATCH_COLUMNS})
    got = names.token_overlap_match(open_names, lookup)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["CERT"] for r in got.collect() if r["SEC_MATCH_TYPE"] == "fuzzy_0.75"} == {str(i) for i in range(9)}


def test_near_names_take_no_rounds(frame, monkeypatch):
    """Ten words, three of which all names share: a name with a near one is found by what both leave, the others by rounds.
    Names are normalised after they are dealt."""
    plans, write = [], names.cut_lineage
    monkeypatch.setattr(names, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    monkeypatch.setattr(names, "SPLIT_ROWS", 4)
    rng = random.Random(5)

    def name(many):
        return ["farm", "merch", "comm"] + [f"{kind}{rng.randrange(many)}" for kind in "abcdefg"]

    registered = [name(3) for _ in range(80)]
    near = []
    for words in registered:
        words = rng.sample(words, 10)
        near.append(rng.choice([words, words[1:], words + ["other"], words[1:] + ["other"], words[1:] + ["a1"]]))

    def check(asked):
        registry = frame(REG, [(i, i, "T", " ".join(n)) for i, n in enumerate(registered)])
        open_names = frame(INST, [(str(i), i, " ".join(n)) for i, n in enumerate(asked)]).withColumn("INST_NAME_NORM", F.col("NAME")).withColumns(
            {c: F.lit(None).cast("long" if c == "SEC_CIK" else "string") for c in names.MATCH_COLUMNS})
        del plans[:]
        got = by(names.token_overlap_match(open_names, names.registry_lookup(registry)), "CERT")
        sets = [(i, set(n)) for i, n in enumerate(registered)]
        for i, n in enumerate(asked):
            want, row = brute(set(n), sets), got[str(i)]
            assert (row["SEC_CIK"], row["SEC_MATCH_TYPE"]) == ((want[1], f"fuzzy_{want[0]:.2f}") if want else (None, None))
        return len(plans)

    assert check(near) <= 10
    assert not [line for plan in plans for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]
    assert check(near[:20] + [name(4) for _ in range(20)] + [["farm", "merch", "comm", "x1", "x2"]]) > 10
