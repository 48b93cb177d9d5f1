"""Each operator beside brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from datetime import datetime, timedelta

import pytest

from loomgraph.llm import components, cross_split, leakage, mixing, names, near, nearest_time, residue, site_lines

ARTICLE = "article_id string, _title string, _article string, _ticker string, _date timestamp, _url string, text string, id string"
WORDS = [f"w{i}x" for i in range(900)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def runs(title, body, n=3):
    w = re.findall("[a-z0-9]+", ((title or "") + "\n" + body).lower())
    return set(zip(*[w[i:] for i in range(n)]))


@pytest.fixture(scope="module")
def articles():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = prose(rng, rng.choice([12, 60, 150, 400]))
        title = None if i % 7 == 0 else prose(rng, 5)
        rows.append((f"A{i:03d}", title, base))
        for k in range(rng.randint(0, 3)):
            rows.append((f"A{i:03d}{k}", title, edited(rng, base, rng.choice([0.02, 0.05, 0.12, 0.3]))))
    rows += [("C1", "Same, Title!", "THE very same words - here, again and again"), ("C2", "same title", "the very  same words here again and again"), ("C3", "same title", "the very same words here again and again")]
    rows += [("N1", "title", None), ("N2", "title", "  \n"), ("N3", None, "a b"), ("L1", None, prose(rng, 30000)), (None, "x", prose(rng, 50))]
    rows += rows[:5]
    return [(a, t, b, "T", None, None, "clash", "clash") for a, t, b in rows]


def test_near_pairs_equal_brute_force(spark, articles):
    df = spark.createDataFrame(articles, ARTICLE)
    got = {(r.id_a, r.id_b) for r in near.near_pairs(near.article_records(df)).collect()}
    texts = {a: " ".join(re.findall("[a-z0-9]+", ((t or "") + "\n" + b).lower())) for a, t, b, *_ in articles if a and b and b.strip()}
    rep = {}
    for a in sorted(texts):
        rep.setdefault(texts[a], a)
    sets = {a: s for t, a in rep.items() if (s := runs(None, t))}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    # Copies are tied to their representative only.
    want |= {(rep[t], a) for a, t in texts.items() if rep[t] != a and rep[t] in sets}
    assert got == want and {("C1", "C2"), ("C1", "C3")} <= got


def test_near_classes_have_a_row_each(spark, articles):
    df = spark.createDataFrame(articles, ARTICLE)
    rows = near.near_duplicate_classes(near.article_records(df)).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.class_id for r in rows if r.id in ("C1", "C2", "C3")} == {"C1"}


def test_near_pairs_over_batches_and_hot_keys(spark, articles):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    old, near.HOT = near.HOT, 2
    try:
        test_near_pairs_equal_brute_force(spark, articles)
    finally:
        near.HOT = old
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_takes_repeated_bodies_and_any_threshold(spark):
    rng = random.Random(9)
    body = " ".join(rng.sample(WORDS, 39))
    rows = [("a", body), ("b", f"{body} {body} {body}"), ("c", " ".join(rng.sample(WORDS, 200))), ("d", "x y z"), ("e", "x y z q")]
    rows += [("f", " ".join(w if i % 16 else "odd" + str(i) for i, w in enumerate(rows[2][1].split())))]
    df = spark.createDataFrame(rows, "id string, text string")
    sets = {i: runs(None, t) for i, t in rows}
    for least in (0.3, 0.5, 0.7, 0.9):
        want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
        assert {(r.id_a, r.id_b) for r in near.near_pairs(df, 3, least).collect()} == want
    assert ("a", "b") in {(r.id_a, r.id_b) for r in near.near_pairs(df, 3, 0.9).collect()}


def test_near_of_records_that_are_mostly_furniture(spark):
    rng = random.Random(10)
    furniture = prose(rng, 120)
    rows = [(f"r{i:03d}", f"{prose(rng, 60)} {furniture}") for i in range(300)] + [(f"s{i}", f"{furniture} {prose(rng, 3)}") for i in range(4)]
    sets = {i: runs(None, t) for i, t in rows}
    ids = sorted(sets)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id string, text string").repartition(parts)
        assert {(r.id_a, r.id_b) for r in near.near_pairs(df).collect()} == want and len(want) > 1000


def test_near_groups(spark):
    rng = random.Random(11)
    a = prose(rng, 100)
    b = " ".join(a.split()[20:]) + " " + prose(rng, 20)
    c = " ".join(b.split()[20:]) + " " + prose(rng, 20)
    df = spark.createDataFrame([("1", a), ("2", b), ("3", c), ("4", prose(rng, 100)), ("5", None)], "id string, text string")
    assert {tuple(r) for r in near.near_duplicate_groups(df).collect()} == {("1", "1"), ("2", "1"), ("3", "1")}


def test_near_on_hot_copies_and_empty(spark):
    hot = spark.range(3000).selectExpr("concat('H', id) as id", "'one text that a third of all rows repeat word for word' as text")
    assert near.near_pairs(hot).count() == 2999
    assert near.near_pairs(hot.limit(0)).count() == 0


def test_cross_split(spark):
    day = lambda n: datetime(2020, 1, n, 12)
    rng = random.Random(1)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [("E1", None, edited(rng, a, 0.05), " t1 ", day(2), None, "", ""), ("R1", None, a, "T1", day(1), None, "", ""), ("E2", None, b.upper(), "T1", day(3), None, "", ""), ("R2", None, b, "T1", day(1), None, "", ""),
            ("E3", None, prose(rng, 80), "T1", day(2), None, "", ""), ("X", None, a, None, day(2), None, "", ""), ("Y", None, a, "T1", None, None, "", "")]
    tasks = spark.createDataFrame([("T1", day(1).date(), "train"), ("T1", day(2).date(), "val"), ("T1", day(3).date(), "test"), (None, day(2).date(), "val"), ("T1", day(3).date(), "test")], "ticker string, cutoff_date date, split string")
    got = {tuple(r) for r in cross_split.article_overlaps(spark.createDataFrame(rows + rows, ARTICLE), tasks).collect()}
    assert got == {("E1", "val", False), ("E2", "test", True)}
    assert cross_split.article_overlaps(spark.createDataFrame([], ARTICLE), tasks).count() == 0


def test_site_lines(spark):
    rows = []
    for i in range(10):
        body = f"Share {i} this\r\n\r\nown words {'x' * i}\nEND  of   page"
        rows.append((f"A{i}", None, body, None, None, ["https://www.S.example:80/x", "s.example/y?z", "HTTP://m.s.example", "user@amp.s.example/"][i % 4], "", ""))
    rows += [(f"B{i}", None, "end of page", None, None, "other.example/" if i < 7 else None, "", "") for i in range(9)] + [("N", None, None, None, None, "s.example", "", "")]
    df = spark.createDataFrame(rows + rows[:3], ARTICLE)
    got = {tuple(r) for r in site_lines.repeated_lines(df).collect()}
    assert got == {(f"A{i}", n) for i in range(10) for n in (1, 4)}
    cleaned = {r.article_id: r for r in site_lines.without_repeated_lines(df).collect()}
    assert cleaned["A2"].text == "\nown words xx" and cleaned["A2"].removed == 2 and cleaned["B1"].text == "end of page"
    blocks = {r.line: r for r in site_lines.boilerplate_blocks(df).collect()}
    assert set(blocks) == {"share # this", "end of page"} and blocks["share # this"].articles == 10
    # The two lines follow each other only with the articles' own lines between, so they are blocks of their own.
    assert {r.block for r in blocks.values()} == {"share # this", "end of page"}
    assert site_lines.repeated_lines(df.limit(0)).count() == 0


def test_site_lines_make_blocks(spark):
    rows = [(f"A{i}", None, f"one\n\ntwo\nown {'y' * i}\nthree", None, None, "s.example", "", "") for i in range(9)] + [("B", None, "two\none", None, None, "s.example", "", "")]
    df = spark.createDataFrame(rows, ARTICLE)
    assert {(r.line, r.block, r.articles) for r in site_lines.boilerplate_blocks(df).collect()} == {("one", "one", 10), ("two", "one", 10), ("three", "three", 9)}
    old, site_lines.MOST_HOT = site_lines.MOST_HOT, 2
    try:
        assert site_lines.repeated_lines(df).count() == 29
    finally:
        site_lines.MOST_HOT = old


def test_nearest_in_time_equals_brute_force(spark):
    rng = random.Random(3)
    base = datetime(2021, 3, 1)
    at = lambda: base + timedelta(minutes=rng.randrange(60 * 24 * 20))
    left = [(f"L{i}", rng.choice(["A", "B", "C", "", None]), at() if i % 11 else None, "clash") for i in range(400)]
    right = [(f"R{i}", rng.choice(["A", "A", "B"]), at() if i % 13 else None, "clash") for i in range(150)]
    right += [("R0b", right[1][1], right[1][2], "clash"), ("Rx", "A", base, "c"), ("Ry", "A", base + timedelta(hours=12), "c")]
    left += [("Lmid", "A", base + timedelta(hours=6), "c")] + left[:3]
    schema = "id string, entity string, t timestamp, match string"
    got = {(r.id, r.match) for r in nearest_time.nearest_in_time(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 6 * 3600).collect()}
    want = set()
    for i, e, t, _ in left:
        near_ = sorted((abs(u - t), u, j) for j, f, u, _ in right if e and t and u and f == e and abs(u - t) <= timedelta(hours=6))
        if near_:
            want.add((i, near_[0][2]))
    assert got == want
    empty = spark.createDataFrame([], schema)
    assert nearest_time.nearest_in_time(empty, empty, 10).count() == 0


def test_nearest_in_time_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_nearest_in_time_equals_brute_force(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)] + [("hub", f"s{i}") for i in range(500)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    pairs += [(f"p{rng.randrange(80)}", f"p{rng.randrange(80)}") for _ in range(60)] + [("self", "self"), (None, "x"), ("hub", "s1")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "x string, y string")).collect()))
    assert got == {v: root(v) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_event_groups(spark):
    nodes = spark.createDataFrame([(f"event:{c}", "Event") for c in "abcde"] + [("event:a", "Event"), ("x", "Entity")], "node_id string, node_type string")
    edges = spark.createDataFrame(
        [("article:1", "event:b", "SAME_AS", " a "), ("event:b", "event:c", "SAME_AS", None), ("event:d", "event:d", "SAME_AS", None), ("event:d", "event:zz", "SAME_AS", None), ("x", "event:d", "SAME_AS", None), ("event:d", "event:e", "RELATED_TO", None)],
        "source string, target string, edge_type string, event_id string",
    )
    assert {tuple(r) for r in components.event_groups(nodes, edges).collect()} == {(f"event:{c}", "event:a") for c in "abc"}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, "c", prose(rng, 60)) for i in range(8)] + [(8, "c", None), (9, "c", "too short")]
    docs = []
    for i in range(120):
        text = prose(rng, 50)
        if i % 2:
            w = items[i % 8][2].split(" ")
            k = rng.choice([11, 12, 13, 30])
            text += " , ".join([" ", *w[5 : 5 + k], " "]).upper() + prose(rng, 20)
        docs.append((i, text, "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, prose(rng, 20000), "")] + docs[:4]
    D, I = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items + items[:2], "item_id long, category string, text string")
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 11)}
    own = {i: grams(t) for i, _, t in items}
    want = {(d, i) for d, t, _ in docs for i, g in own.items() if g & grams(t)}
    assert {tuple(r) for r in leakage.shared_runs(D, I).collect()} == want and want
    old, leakage.BLOCK_CHARS = leakage.BLOCK_CHARS, 700
    try:
        assert {tuple(r) for r in leakage.shared_runs(D, I).collect()} == want
    finally:
        leakage.BLOCK_CHARS = old
    assert leakage.shared_runs(D, I.limit(0)).count() == 0 and leakage.shared_runs(D.limit(0), I).count() == 0


def test_edited_passages_are_found(spark):
    rng = random.Random(6)
    item = prose(rng, 60)
    hurt = item[:100] + "z" + item[101:180] + item[182:]
    D = spark.createDataFrame([(1, prose(rng, 30) + " " + hurt, ""), (2, prose(rng, 90), "")], "doc_id long, text string, x string")
    I = spark.createDataFrame([(7, "c", item)], "item_id long, category string, text string")
    rows = leakage.leaked_passages(D, I).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 7)] and rows[0].edits >= 1
    assert {tuple(r) for r in leakage.leaked_items(D, I).select("item_id", "documents").collect()} == {(7, 1)}


def test_passages_of_few_edits_are_all_found(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnop"
    words_ = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words_) for _ in range(n))

    def hurt(t, n):
        for _ in range(n):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", rng.choice(letters), t[k] + rng.choice(letters)]) + t[k + 1 :]
        return t

    items = [(i, "c", text(30)) for i in range(3)]
    middle = items[0][2]
    docs = [(i, text(10) + " " + hurt(items[i % 3][2][s : s + 85], n) + " " + text(10)) for i, (s, n) in enumerate([(0, 0), (20, 2), (40, 4), (10, 6), (60, 8), (30, 12), (50, 3), (5, 4), (25, 1)])]
    # Two passages with something of about the same length between them, and one at the end of an item with an edit near its start.
    docs += [(20, middle[:85] + text(4)[:20].ljust(20, "q") + middle[105:]), (21, "x " + middle[-85:-78] + "q" + middle[-77:]), (22, text(40))]

    def least_edits(own, t):
        row = [0] * (len(t) + 1)
        for k, x in enumerate(own, 1):
            after = [k]
            for j, y in enumerate(t, 1):
                after.append(min(after[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = after
        return min(row)

    must = {(d, i) for d, t in docs for i, _, own in items if any(least_edits(own[k : k + 80], t) <= 4 for k in range(0, len(own) - 79, 5))}
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, category string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(D, I).collect()}
    assert must <= got and {(0, 0), (20, 0), (21, 0)} <= got and not {d for d, _ in got} & {22}


def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", "b", "rare"]) if i % 50 else "rare", prose(rng, rng.randrange(20, 60)), rng.choice(["en", "de", None]), rng.choice(["news", "note"])) for i in range(3000)]
    rows += [(9001, None, "x", "en", "news"), (9002, "a", None, "en", "news"), (9003, "other", "words", "en", "news"), (9004, "a", "", "en", "news")] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, doc_kind string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("rare", 0.4, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs, targets)
    for r in report.collect():
        assert abs(r.share - r.target_share) < 0.01 and r.most_repeats <= r.max_repeats
    assert used.count() == used.select("doc_id").distinct().count() == 3000
    empty, none = mixing.mix(docs.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


@pytest.mark.parametrize("text, own", [
    ("Shares of Acme rose. {{ company }} gained 3%.", True), ("By NaN | Updated NaN", True), ("404 - Not Found. Try a search", True), ("Erreur 404 : page introuvable.", True), ("Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", True),
    ("Lorem ipsum dolor sit amet.", True), ("Prose first.\nAccess denied. Reference #6.1", True), ("The price is [INSERT QUOTE] today.", True), ("Alitus faucen elitor tempora ornate.", True), ("Pay ___ (fill in) now", True),
    ('Readers met an "access denied" banner when it tested its paywall.', False), ("The spread {a; b} runs from 3%; see exhibit [38] at <$84 million.", False), ("A 404-acre site and a $503 fee please Acme.", False), ("It lets developers drop JavaScript from 17% of pages.", False),
    ("She will serve as a placeholder chief, and the template for pay is set.", False), ("Acme [ACMEZ] needs $103 million (sic).", False), ("Acme blamed a null result in the trial.", False), ("", False), (None, False), ("  ", False),
])
def test_residue(text, own):
    assert residue.residue(text)[0] is own


@pytest.mark.parametrize("text", [
    "Scheduled maintenance at the refinery cut output by 4% in June.", "Unauthorized trading cost the bank $2 billion.", "Not found in the filing was any mention of debt.", "Forbidden fruit: why tobacco stocks rose this year.",
    "Under maintenance contracts, revenue rose 4%.", "Internal error rates at the plant fell.", "Service unavailable to rivals gave Acme an edge.", "Placeholder chiefs rarely last.", "Access denied to auditors cost Acme its rating.",
    "The page has moved 300 workers to Leeds.", "Something went wrong at Acme in 1999, investors say.", "Session highs were hit twice.",
])
def test_prose_is_no_residue(text):
    assert residue.residue(text) == (False, 0.0)


@pytest.mark.parametrize("text, least", [
    ("Ha ocurrido un problema al cargar la página de cotizaciones.", 0.3), ("Nous ne trouvons pas cette page.", 0.9), ("Sie müssen JavaScript einschalten, um fortzufahren.", 0.5), ("Please allow scripts to continue reading.", 0.4),
    ("Connection timed out. Try again later.", 0.9), ("You need to switch on cookies for this.", 0.5), ("The requested page could not be found.", 0.9), ("Something went wrong on our side.", 0.3), ("Wir arbeiten. Wartungsarbeiten.", 0.3),
])
def test_residue_covers_its_phrase(text, least):
    strong, coverage = residue.residue(text)
    assert strong and least <= coverage <= 1


def test_residue_tables(spark):
    docs = spark.createDataFrame([(1, "Page not found.", ""), (2, "Plain words about shares. " * 3000 + "Page not found.", ""), (3, None, ""), (4, "Plain.", ""), (1, "Page not found.", "")], "doc_id long, text string, coverage string")
    assert {r.doc_id for r in residue.residue_documents(docs).collect()} == {1, 2} and {r.doc_id for r in residue.residue_documents(docs, 0.5).collect()} == {1}  # half of the text
    assert {r.doc_id for r in residue.without_residue(docs).collect()} == {3, 4} and residue.residue_documents(docs.limit(0)).count() == 0


FIRMS = [("AAAZ", "Venflulstev Motors Holdings, Inc.", '["Little Wartraix"]'), ("BBBZ", "Venflulstev Foods plc", "[]"), ("CCCZ", "Kelsadund Global Airlines N.V.", "broken"), ("DDDZ", "Bank of Drenmev plc", None), ("EEEZ", "Ostaril Motors Ltd.", "[]"), ("FFFZ", "Trumblid Foods AG", "[]"), ("GGGZ", "Zirkano Global Foods Group", "[]"), ("HHHZ", "Quilmarst Airlines Inc.", "[]")]


SPELLED = [
    ("Venflulstev Motors", "AAAZ"), ("VENFLULSTEV MTRS (NYSE: AAAZ)", "AAAZ"), ("Venflusltev Motros Inc", "AAAZ"), ("VenflulstevFoods", "BBBZ"), ("Foods, Venflulstev’s", "BBBZ"), ("little wartraix", "AAAZ"), ("Kelsadund Airlines", "CCCZ"),
    ("Drenmev Bank", "DDDZ"), ("BankofDrenmev", "DDDZ"), ("K.G.A.", "CCCZ"), ("Kelsadund", "CCCZ"), ("Venflulstev", None), ("Venflulstev Airlines", None), ("Kelsadund Foods", None), ("Somewhere Else Motors", None), ("???", None),
]


def test_names(spark):
    typed = spark.createDataFrame([(n,) for n, _ in SPELLED] * 2 + [(None,), (" ",), ("Venflulstev Motors " * 300,)], "name string")
    firms = spark.createDataFrame(FIRMS, "ticker string, company string, aliases_json string")
    got = {r.name: r.ticker for r in names.linked_names(typed, firms).collect()}
    assert got == {n: t for n, t in SPELLED if t}


def test_name_nodes(spark):
    nodes = spark.createDataFrame([("e1", "Entity", "Venflulstev Motors", "x"), ("e1", "Entity", "Venflulstev Motors", "x"), ("e2", "EntityRawMention", None, "AAAZ"), ("e3", "Event", "Venflulstev Motors", None), ("e4", "Entity", " ", None)], "node_id string, node_type string, name string, ticker string")
    firms = spark.createDataFrame(FIRMS, "ticker string, company string, aliases_json string")
    assert [tuple(r) for r in names.linked_nodes(nodes, firms).collect()] == [("e1", "AAAZ")]
    old, names.MOST_POSTINGS = names.MOST_POSTINGS, 1
    try:
        assert [tuple(r) for r in names.linked_nodes(nodes, firms).collect()] == [("e1", "AAAZ")]
    finally:
        names.MOST_POSTINGS = old
    assert names.linked_nodes(nodes, firms.limit(0)).count() == 0 and names.linked_nodes(nodes.limit(0), firms).count() == 0
