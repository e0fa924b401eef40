"""Operators that judge, extract and score: against brute force and on edge cases."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import html, language, quality, toxicity, url_filter
from tallyforge.llm.labelled import logistic, sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, size long, fp long"
EXTRA = (0.5, "h", 7, 9)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], DOCS)


# URLs


def judged(host, path, rules):
    fits = [(len(r), r, v) for r, v in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, "allow")


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "org", "com", "example", "ex"], ["x", "xy", "1", "", "z"]
    rules = sorted({(".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(40)})
    rules = list(dict(rules).items())
    urls = ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) + rng.choice(["", "?q", "#f"]) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in url_filter.judge(pages, url_filter.rules_table(spark, rules)).collect():
        assert (r["rule"], r["verdict"]) == judged(r["host"], r["path"], rules), urls[r["page_id"]]


def taken_apart(url):
    """Host and path by plain steps."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_whole_urls_against_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    parts = ["http", "://", "/", "?", "#", "example.org", "EXAMPLE.com", "a.", "com", ".org", "de/", "/de/", "/en/1", "fr", "es/", "Ä", "\n", "u="]
    urls = [None, "", "http://a.org?u=http://b.com/de/x", "http://x.com#http://example.org/de/1"] + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(600)]
    urls += ["http://" + u for u in urls[4:300]] + ["http://hot.com/de/1"] * 500
    pages = spark.createDataFrame([(i % 700, u, "r", "h", "p", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string, path string, verdict string")
    found = url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES))
    rows = sorted(map(tuple, found.collect()), key=str)
    want = [(i % 700, *(p := taken_apart(u)), *judged(*p, url_filter.RULES)) for i, u in enumerate(urls)]
    assert rows == sorted(want, key=str)
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert sorted(con.sql(url_filter.SQL).fetchall(), key=str) == rows


def test_verdicts_are_joined_where_they_are_many(spark, monkeypatch):
    urls = ["http://a.org/x", "http://b.com/de/1", "http://b.com/", None] * 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.rules_table(spark, url_filter.RULES)
    few = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == few


def test_url_edges(spark):
    urls = [None, "", "nothing", "://", "http://A.ORG", "x://org/", "x://org/", "http://" + "a." * 300 + "org/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES)).collect()}
    assert [found[i]["verdict"] for i in range(8)] == ["allow"] * 8
    assert [found[i]["rule"] for i in range(8)] == [None] * 5 + ["org/"] * 3
    assert (found[0]["host"], found[0]["path"], found[4]["host"]) == ("", "", "a.org")
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0
    none = spark.createDataFrame([], "rule string, host string, path string, verdict string")
    assert url_filter.judge(pages, none).where("rule is null and verdict = 'allow'").count() == 8


def test_an_empty_path_does_not_move_to_a_later_address(spark):
    urls = ["http://example.com?u=http://a.b/de/x", "http://example.com#http://a.b/de/x", "http://example.com", "http://example.com/fr/?u=http://a.b/de/x", "http://example.com/de/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = sorted(url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES)).collect())
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == [("example.com", "", None, "allow")] * 3 + [("example.com", "/fr/", "com/fr/", "allow"), ("example.com", "/de/x", "com/de/", "block")]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bloom = url_filter.Bloom.of(keys, "key")
    hashes = lambda df: df.select(F.xxhash64("key").alias("a"), F.xxhash64(F.xxhash64("key"), F.lit(1)).alias("b")).toPandas()
    own, other = hashes(keys), hashes(spark.range(3000).select(F.concat(F.lit("o"), F.col("id")).alias("key")))
    assert bloom.may_hold(own["a"].to_numpy(), own["b"].to_numpy()).all()
    assert bloom.may_hold(other["a"].to_numpy(), other["b"].to_numpy()).mean() < 0.02
    small = url_filter.Bloom.of(keys, "key", max_bytes=640)
    assert len(small.blocks) == 10 and small.may_hold(own["a"].to_numpy(), own["b"].to_numpy()).all()


# Languages


def slow_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return Counter(w[i : i + n] for w in (f" {x} " for x in words) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip())


def test_grams_by_hand():
    for text in ("Hello, wörld! a b", "x", "don't 42 Über-all\n\n"):
        keys, counts = language.grams(text)
        code = lambda g: sum((0 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        want = Counter()
        for g, n in slow_grams(text).items():
            want[code(g)] += n
        assert dict(zip(keys.tolist(), counts.tolist())) == dict(want)


def test_words_over_a_cut_stay_whole(monkeypatch):
    text = "Straße, " * 40 + "Ŋ" * 50 + " a b  c" * 20
    want = language.grams(text)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(language.grams(text), want))


def test_distances_and_scores_by_hand():
    rng = random.Random(7)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))
    code = lambda g: sum((0 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))

    def order(text, most):
        counts = Counter()
        for g, n in slow_grams(text).items():
            counts[code(g)] += n
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:most]

    slow = {name: order(make(letters, 80), 30) for name, letters in (("aa", "abcdef"), ("bb", "abcghi"), ("cc", "xyz"))}
    profiles = language.Profiles([], [], [], 30)
    for name, ranked in slow.items():
        keys = np.array(ranked)
        profiles.names.append(name)
        profiles.keys.append(np.sort(keys))
        profiles.ranks.append(np.argsort(keys))
    for _ in range(60):
        text = make(rng.choice(["abcdef", "abcghi", "xyza", "q"]), rng.randint(1, 20))
        own = order(text, 30)
        far = {name: sum(abs(ranked.index(g) - i) if g in ranked else 30 for i, g in enumerate(own)) for name, ranked in slow.items()}
        best = min(slow, key=lambda n: (far[n], n))
        assert profiles.judge(text) == (best, 1 - far[best] / (30 * len(own)))
    assert profiles.judge("qqq") == ("aa", 0.0)  # as far from all: the first by name


def test_languages_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert language.op2_language(spark, str(tmp_path)).count() == 0


def test_languages(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))
    rows = [(i, make("abcdefgh" if i % 2 else "stuvwxyz"), ("one", "two")[i % 2], "s") for i in range(40)]
    docs = documents(spark, rows + [(100, None, "one", None), (101, "12 !?", None, None), (102, "", "two", "s"), (None, "abcde", None, None), (1, rows[1][1], "two", "s"), (103, "ABCDE " * 50_000, None, None)])
    profiles = language.fit(docs)
    found = docs.select("doc_id", profiles.column(docs["text"]).alias("j")).select("doc_id", "j.*").collect()
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == ("one", "two")[i % 2] and 0 <= by[i]["score"] <= 1 for i in range(40))
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "two"] and by[None]["lang_pred"] == "two" and by[100]["score"] == 0
    assert len(found) == docs.count()
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 43
    empty = docs.limit(0)
    assert language.fit(empty).judge("abc") == ("und", 0.0) and language.keep_known(empty, profiles).count() == 0


def test_held_out_language_accuracy(spark):
    found = language.op2_language(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[0] >= 0.95 and held[1] > 20


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Home</a></header><nav><ul><li>m1</li><li>m2</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="post post-{n}"><h1>Title &amp; more</h1><p>First   paragraph<br>of text, number {n}.<p><b>Second &eacute;<br><p>Third <a href="x">link</a>.</p>
<div class="ad">Buy</div><form><input value="v">Search</form><script>if (a < b) "</p>"</script><!-- c --><section id="comments"><p>A reader wrote a very long remark here, much longer than all the rest of this page together, on and on.</p></section></div>
<aside>Side text that is long enough to matter, but it does not belong here.</aside><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(n, f"http://h.org/{n}", PAGE.replace("{n}", str(n))) for n in range(6)] + [(6, "http://h.org/x", "<body><div class='post post-77'>Short</div><div class='other'><p>Longer text than the post, but the host votes for posts.</p></div></body>")]
    rows += [(7, None, "<p>No host</p>"), (8, "http://g.org", None), (9, "http://g.org", ""), (10, "http://g.org", "plain &lt;text&gt;\n here"), (1, rows[1][1], rows[1][2]), (11, "http://f.org", "<div><p>" + "word " * 200_000 + "</div>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    found = html.extract(pages).collect()
    by = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    for n in range(6):
        assert by[n]["text"] == f"Title & more\n\nFirst paragraph of text, number {n}.\n\nSecond é\n\nThird link."
        assert by[n]["n_chars"] == len(by[n]["text"])
    assert by[6]["text"] == "Short" and by[7]["text"] == "No host" and by[8]["text"] == by[9]["text"] == "" and by[10]["text"] == "plain <text> here" and by[11]["n_chars"] == 999_999
    assert html.extract(pages.limit(0)).count() == 0


def test_main_text_keeps_what_stands_beside_the_body(spark):
    body = "".join(f"<p>{'long text ' * 30}{i}</p>" for i in range(4))
    page = "<body><div class=menu>Menu</div><article><h1>Title {n}</h1><p>Lead.</p><div class=body>" + body + "</div><div class=share>Share</div></article><p>Below</p></body>"
    pages = spark.createDataFrame([(n, f"http://h.org/{n}", page.replace("{n}", str(n))) for n in range(4)], "page_id long, url string, html string")
    want = [f"{'long text ' * 30}{i}" for i in range(4)]
    for r in html.extract(pages).collect():
        assert r["text"].split("\n\n") == [f"Title {r['page_id']}", "Lead.", *want]
    for tag, path in (("main", "/main"), ("div", "/div/div.body")):  # a plain container is not taken for the body's
        found = html.Page(page.replace("article", tag))
        assert found.paths[found.best()[0]] == path


def test_main_text_of_odd_markup():
    text = lambda h: html.Page(h).text([])
    assert text('<p title="a>b">q</p><p>broken <a href="x>y</p>') == "q\n\nbroken y"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<p>in<b>l</b>ine <span hidden>no</span>yes</p>") in ("inline\n\nyes", "inline yes")


@pytest.mark.parametrize("html_text", ["<div>" * 200_000 + "deep", "<a " * 200_000, "<b><div></div>" * 50_000 + "deep", "<blockquote>deep " * 30_000, "<div>" * 30_000 + "<li></li>" * 30_000 + "deep", "<svg>" * 50_000 + "deep", "<a '>' " * 50_000 + '"', "<div class='c7 d'>" * 50_000 + "deep"], ids=range(8))
def test_main_text_of_long_markup_takes_linear_time(html_text):
    import time

    began = time.process_time()
    page = html.Page(html_text)
    text = page.text([page.paths[page.best()[0]]])
    assert text or html_text.startswith("<a")
    assert time.process_time() - began < 30


def slow_text(node, dull=False):
    """Blocks of a generated tree, by recursion."""
    tag, attributes, children = node
    dull = dull or tag in ("nav", "footer", "script") or "hidden" in attributes
    blocks, line = [], []
    for child in children:
        if isinstance(child, str):
            line.append(child)
            continue
        if line:
            blocks.append(("".join(line), dull))
            line = []
        blocks += slow_text(child, dull)
    if line:
        blocks.append(("".join(line), dull))
    return [b for b in blocks if tag != "script"]


def test_main_text_of_generated_trees():
    rng = random.Random(6)

    def tree(depth):
        tag = rng.choice(["div", "section", "p", "nav", "footer", "script"]) if depth < 4 else "p"
        attributes = " hidden" if rng.random() < 0.1 and tag == "div" else ""
        if tag in ("p", "script"):
            return tag, attributes, [f"text {rng.randrange(1000)}"]
        return tag, attributes, [tree(depth + 1) for _ in range(rng.randint(1, 4))]

    def shown(node):
        tag, attributes, children = node
        return f"<{tag}{attributes}>" + "".join(c if isinstance(c, str) else shown(c) for c in children) + f"</{tag}>"

    for _ in range(300):
        node = ("article", "", [tree(0) for _ in range(rng.randint(1, 5))])
        page = html.Page(f"<html><body><nav><p>menu</p></nav>{shown(node)}<footer><p>end</p></footer></body></html>")
        want = "\n\n".join(t for t, dull in slow_text(node) if not dull)
        assert page.text(["/article"]) == want and page.text(["/none"]) == want


def test_votes_and_ties_between_paths(spark):
    one, two = "<div class=a><p>text</p></div>", "<div class=b><p>text</p></div>"
    rows = [(i, "http://h.org/x", h) for i, h in enumerate([one, two])] + [(9, "http://h.org/y", one.replace("text", "first") + two.replace("text", "other"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["paths"] for r in html.winners(pages.where("page_id < 2")).collect()] == [["/div.a", "/div.b"]]  # as many votes: the first by name
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == {0: "text", 1: "text", 9: "first"}
    assert html.Page("<div class='w-1/2'><p>x</p></div>").text(["/div.w-#%2F#"]) == "x"


# Toxicity


def test_folding():
    assert toxicity.fold("1D10T!!! $TUPID i.d ＩＤＩＯＴ іdiоt l0ser").split() == ["idiot", "stupid", "i", "d", "idiot", "idiot", "ioser"]


def labelled_corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice("red blue green gold silver black white small large round".split()) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for at in rng.sample(range(40), 3):
                words[at] = rng.choice(["grumbo", "Gr0mbix", "flarg!"])
        elif i % 25 == 1:
            words[5:7] = ["flarg", "cake"]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels + [(0, 0, 1), (None, 1, 1), (5, None, None), (999_999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled_corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    assert " fiarg cake " in lexicon.phrases and any(t.startswith(" grumbo") for t in lexicon.terms)
    scores = {r[0]: r[1] for r in docs.select("doc_id", lexicon.column(docs["text"])).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(300))
    odd = lexicon.score([None, "", "red blue", "you GRUMB0", "flarg cake", "x" * 1_000_000])
    assert (odd[[0, 1, 2, 4, 5]] < 0.3).all() and odd[3] >= 0.3 and odd[0] == odd[1]
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 225
    assert toxicity.keep_clean(docs.limit(0), lexicon).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled_corpus(spark)
    assert toxicity.fit(docs, labels.limit(0)).score(["flarg"])[0] < 1e-6
    assert toxicity.fit(docs.limit(0), labels).score(["flarg"])[0] < 1e-6
    ones = labels.where("toxic = 1 and doc_id is not null")
    assert toxicity.fit(docs, ones).score(["red"])[0] > 0.99


def test_hits_by_hand():
    lexicon = toxicity.Lexicon({" bad ": 2.0, " wor": 1.5}, [" bad luck "])
    for text in ("bad bad worse world", "bad luck", "bad luck bad", "abad sword", ""):
        folded = toxicity.fold(text)
        want = []
        for term, w in lexicon.terms.items():
            at = folded.find(term)
            while at >= 0:
                phrase = folded.find(" bad luck ")
                if not (phrase >= 0 and phrase <= at and at + len(term) <= phrase + 10):
                    want.append((at, at + len(term), w))
                at = folded.find(term, at + 1)
        assert sorted(lexicon.hits(folded)) == sorted(want)


def test_hits_among_many_phrases_against_brute_force():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({" bad ": 2.0, " wor": 1.5, " b": 0.5}, [" bad duck ", " duck bad duck ", " so bad "])
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choices(["bad", "duck", "so", "worse", "b", "x"], k=rng.randint(0, 25))))
        every = lambda t: [(i, i + len(t)) for i in range(len(folded)) if folded.startswith(t, i)]
        spans = [s for p in lexicon.phrases for s in every(p)]
        want = [(a, b, w) for t, w in lexicon.terms.items() for a, b in every(t) if not any(c <= a and b <= d for c, d in spans)]
        assert sorted(lexicon.hits(folded)) == sorted(want)
    many = toxicity.fold("bad duck " * 40_000)
    assert {w for _, _, w in lexicon.hits(many)} == set()


def test_terms_of_words_by_hand():
    found = toxicity._Terms().counts("grumbo grumbo ab " + "x" * 100)
    want = {"": 4, " grumbo ": 2, " gru": 2, " grum": 2, " grumb": 2, f" {'x' * 100} ": 1} | {f" {'x' * n}": 1 for n in [*range(3, 33), 64]}
    assert found == want
    assert max(map(len, toxicity._Terms().counts("z" * 5000))) == 257
    among = toxicity._Terms(frozenset([" gru", " grum", " grumbo "]))
    assert among.counts("grumbo grumpy grind") == {"": 3, " gru": 2, " grum": 2, " grumbo ": 1}


def test_long_words_in_labelled_texts(spark):
    docs, labels = labelled_corpus(spark)
    long = documents(spark, [(4 * i, "y" * 1_000_000 + " flarg", "en", "s") for i in range(1000, 1012)])
    more = spark.createDataFrame([(4 * i, 1, 1) for i in range(1000, 1012)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs.union(long).union(docs), labels.union(more))  # and repeated rows
    assert lexicon.score(["you flarg!", "x" * 10_000])[0] >= 0.3 and max(map(len, lexicon.terms)) <= 258


def test_scores_by_hand():
    lexicon = toxicity.Lexicon({" bad ": 2.0, " wor": 1.5}, [" bad duck "], -1.0, (0.5, 0.25, 0.125))
    for text, weights, n in (("bad duck", [], 2), ("so bad worse bad duck", [2.0, 1.5], 5), (None, [], 0), ("worst", [1.5], 1)):
        x = [np.log1p(sum(weights)), np.log1p(1000 * sum(weights) / max(1, n)) if weights else 0.0, max(weights, default=0.0)]
        assert np.isclose(lexicon.score([text])[0], 1 / (1 + np.exp(1 - x[0] / 2 - x[1] / 4 - x[2] / 8)))


def test_held_out_toxicity(spark):
    found = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    tp, fp, fn = found.agg(*[F.sum((F.expr(e)).cast("int")) for e in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0", "predicted = 0 and toxic = 1")]).first()
    assert tp / (tp + fn) > 0.85 and tp / (tp + fp) > 0.85


# Quality


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = quality.grow(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(row):
        total = trees.bias
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])
    assert (quality.grow(x[:5], np.ones(5)).score(x) > 0.99).all() and (quality.grow(x[:0], y[:0]).score(x) == 0.5).all()
    assert len(trees.score(x[:0])) == 0


def test_statistics_of_odd_texts():
    for text in (None, "", " \n ", "a", "é" * 100_000, "\ud800", "A!! " * 1000):
        found = quality.statistics(text)
        assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()
    assert quality.statistics(None) == quality.statistics("")


def test_held_out_quality(spark):
    found = quality.op5_quality(spark, "/root/testdata/sf0.01")
    assert found.count() == 1000
    right = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_sample_is_bounded(spark):
    docs, labels = labelled_corpus(spark)
    assert sample(docs, labels, "toxic", 4, 2, most=50).count() <= 50
    learned = sample(docs, labels, "quality", 5, 0)
    assert learned.count() == labels.where("quality is not null and doc_id is not null and doc_id < 300").select("doc_id").distinct().where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()


def test_rows_of_one_labelled_id_count_once(spark):
    docs = documents(spark, [(1, f"text {i}", "en", "s") for i in range(3000)] + [(1, None, "en", "s"), (2, "two", "en", "s")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    found = sample(docs.union(docs), labels, "quality", 5, 99).collect()
    assert len(found) == 2 and {r["y"] for r in found} == {0, 1} and all(r["text"] for r in found)
    assert found == sample(docs.repartition(3), labels, "quality", 5, 99).collect() or sorted(found) == sorted(sample(docs.repartition(3), labels, "quality", 5, 99).collect())
    assert sample(docs, labels, "quality", 5, 99, most=1).count() == 1


def test_quality_of_edges(spark):
    docs, labels = labelled_corpus(spark)
    trees = quality.fit(docs.union(docs), labels)
    assert len(trees.score(quality._matrix([]))) == 0
    assert (quality.fit(docs.limit(0), labels).score(quality._matrix(["a", None])) == 0.5).all()


def test_logistic():
    x = np.column_stack([np.ones(400), np.linspace(-3, 3, 400)])
    w = logistic(x, (x[:, 1] > 1).astype(float))
    assert w[1] > 0 and abs(-w[0] / w[1] - 1) < 0.2
