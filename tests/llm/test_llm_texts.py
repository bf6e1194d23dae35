"""HTML extraction, personal data, toxicity, line dedup and quality rules against plain Python."""

import hashlib
import random
import re

import fixture
import pytest
from pyspark.sql import functions as F

from fieldtrial.llm import html_extract, line_dedup, pii, quality_rules, toxicity

PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1>"
     "<p>one  <b>two</b>\nthree<p>four&nbsp;five</article><footer>f</footer>", "A & B\none two three\nfour five"),
    ("<body><header>h</header><div class='ad'>buy</div><div><p>in<i>li</i>ne</p>text</div>"
     "<div class=\"user-comments\"><p>nice</p></div></body>", "inline\ntext"),
    ("<main><p>a<script>var x='</p>';</script>b</p><form><p>mail</p></form><!-- <p>no</p> --></main>", "ab"),
    ("<article>x<aside>no</aside>y<article class='comment'>no</article></article>", "x\ny"),
    ("plain &lt;text&gt; a < b", "plain <text> a < b"),
    ("<p>cut &am", "cut &am"),
    ("<p>cut <a href=\"x", "cut"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<style>p{}</style><script>never closed <p>x</p>", ""),
    ("", ""),
    (None, ""),
    ("<" * 5000, "<" * 5000),
    ("<b>" * 3000 + "x", "x"),
]


def test_html(spark):
    rows = [(k, None if k % 3 else f"https://site{k}.example.org/{k}", source, 1) for k, (source, _) in enumerate(PAGES)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect())
    expected = [(k, text, len(text)) for k, (_, text) in enumerate(PAGES)]
    assert got == sorted(expected + [expected[0]])
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_template_of_a_site(spark):
    def page(k):
        return f"<body><div class='x1'><p>We use biscuits</p></div><div class='x2'><p>Story {k}</p></div></body>"

    rows = [(k, f"http://a.example.org/{k}", page(k)) for k in range(20)]
    rows += [(100 + k, f"http://b.example.org/{k}", page(k)) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert texts[7] == "Story 7"  # a path that never varies on a site with many pages
    assert texts[101] == "We use biscuits\nStory 1"  # too few pages to judge


def test_html_entropy_inside_and_outside_of_articles(spark):
    def main(k):
        return f"<main><div class='x1'>We use biscuits</div><div class='x2'><p>Story {k}</p></div></main>"

    def cards(k):
        return f"<div class='x3'><p>Long story {k}</p></div><article><p>Try our shop</p></article>"

    layout = "<div class='layout has-sidebar'><div class='page-header-below'><article><p>A long tale</p></article></div><div class='left-sidebar'>x</div></div>"
    rows = [(k, f"http://a.example.org/{k}", main(k)) for k in range(20)]
    rows += [(100 + k, f"http://b.example.org/{k}", cards(k)) for k in range(20)] + [(200, None, layout)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert (texts[7], texts[107], texts[200]) == ("Story 7", "Long story 7", "A long tale")


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    sample = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    awkward = [(100_000 + k, t) for k, t in enumerate(fixture.texts())] + [(None, "a@b.org"), (1, "a@b.org"), (1, "a@b.org")]
    df = sample.unionByName(spark.createDataFrame(awkward, "doc_id long, text string")).withColumn("base", F.lit(1))
    found = pii.personal_data(df)
    text = {(r.doc_id, r.h): r.text or "" for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()}
    rows = found.collect()
    assert len(rows) == df.count()
    added = 0
    for r in rows:
        own = text[(r.doc_id, r.text_hash)]
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == plain_spans(own)
        for s in r.added:
            added += 1
            assert own[s.start : s.end] == s.match
            assert not any(b.start < s.end and s.start < b.end for b in r.base)
    assert added > 0  # a phone number that the base loses in a longer run
    digests = {r.doc_id: r for r in pii.summary(found).where("doc_id >= 100000").collect()}
    for doc_id, t in awkward[:-3]:
        base = plain_spans(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = digests[doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
    assert pii.summary(pii.personal_data(df.limit(0))).count() == 0


def spans_added(rows):
    return {r.doc_id: {s.match for s in r.added} for r in rows}


def test_personal_data_that_no_base_pattern_has(spark):
    rng = random.Random(3)

    def number(first):
        return f"{first}{rng.randrange(100):02} {rng.randrange(200, 999)}-{rng.randrange(10**4):04}"

    docs = [(k, f"call +1 ({number(rng.randrange(2, 10))[:3]}) 555-{k:04} or u{k}@h{k}.org today") for k in range(300)]
    docs += [(1000 + k, f"part {number(rng.randrange(2))} and 999.{k}.1.1 w{k}") for k in range(100)]
    planted = ["(555) 123-4567", "a (at) b (dot) org", "j.doe [at] mail.example.com", "212-555-0199"]
    docs += [(2000 + k, f"w1 {t}. Then w2") for k, t in enumerate(planted)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spans_added(pii.personal_data(df).collect())
    assert [got[2000 + k] for k in range(len(planted))] == [{t} for t in planted]
    assert all(not got[k] for k in [*range(300), *range(1000, 1100)])
    alone = df.where("doc_id >= 2000")  # no base span anywhere
    assert spans_added(pii.personal_data(alone).collect()) == {2000 + k: {t} for k, t in enumerate(planted)}


def test_personal_data_among_copies(spark):
    planted = "card 12 4111 1111 1111 1111 end"  # the base loses the card in a longer run
    docs = [(k, f"mail u{k % 3}@h.org now") for k in range(900)]
    docs += [(1000 + k, f"ip 999.{k}.1.1 mail v{k}@h{k}.org") for k in range(60)] + [(2000 + k, planted) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spans_added(pii.personal_data(df, max_sample=90).collect())
    assert got[2000] == got[2001] == {"4111 1111 1111 1111"}
    assert all(not v for k, v in got.items() if k < 2000)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.org and 1.2.3.4!")], "doc_id long, text string")
    found = pii.personal_data(df).join(df, "doc_id")
    assert found.select(pii.redact(F.col("text"), F.concat("base", "added"))).first()[0] == "é <email> and <ip>!"


def area(scores, labels):
    order = sorted(range(len(scores)), key=scores.__getitem__)
    ranks = sum(k + 1 for k, i in enumerate(order) if labels[i])
    n = sum(labels)
    return (ranks - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(9)
    bad = ["scoundrel", "blockhead", "nitwit"]
    docs, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        words = fixture.sentence(rng, rng.randrange(5, 80)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    tests = ["sco.undrel", "bl0ckhead", "b l o c k h e a d", "scoundxrel", "SCOUNDREL!!"]
    clean = [fixture.sentence(rng, 40) for _ in range(20)]
    docs += [(1000 + k, f"the of and {t} {t} in w1 {t}", "x") for k, t in enumerate(tests)]
    docs += [(2000 + k, t, "x") for k, t in enumerate(clean)] + [(3000, None, "x"), (3001, "", "x"), (None, "w1", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(df, known).collect()}
    assert len(rows) == len(docs)
    held = [r for k, r in rows.items() if k is not None and k < 600 and r.held_out]
    assert area([r.score for r in held], [r.doc_id % 3 == 0 for r in held]) > 0.97
    assert all(rows[1000 + k].predicted == 1 for k in range(len(tests)))
    assert all(rows[2000 + k].predicted == 0 for k in range(len(clean)))
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[3000].score == rows[3001].score
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(df, flipped).collect()}
    assert again == {k: r.score for k, r in rows.items()}  # held-out labels are never learned
    none = toxicity.toxicity(df, known.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_of_many_rare_insults(spark):
    rng = random.Random(12)
    bad = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(200)]
    docs, labels = [], []
    for k in range(1800):
        words = fixture.sentence(rng, rng.randrange(5, 60)).split()
        for _ in range(2 * (k % 3 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert area([r.score for r in rows], [r.doc_id % 3 == 0 for r in rows]) > 0.9


def plain_dedup(docs, min_words):
    """Every run of lines with enough words that occurs earlier is cut, over all pairs of places."""
    first, cut, lines = {}, {}, {}
    for d, text in sorted(docs):
        own = [x.strip() for x in (text or "").split("\n") if x.strip()]
        lines[d], cut[d] = own, set()
        for s in range(len(own)):
            words = 0
            for e in range(s, len(own)):
                words += len(own[e].split())
                if words >= min_words:
                    key = tuple(own[s : e + 1])
                    if first.setdefault(key, (d, s)) < (d, s):
                        cut[d].update(range(s, e + 1))
    out = {}
    for d, text in docs:
        kept, pos = [], 0
        for line in (text or "").split("\n"):
            if not line.strip() or pos not in cut[d]:
                kept.append(line)
            pos += bool(line.strip())
        out[d] = ("\n".join(kept) if cut[d] else text, len(cut[d]))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [fixture.sentence(rng, rng.randrange(1, 30)) for _ in range(25)]
    docs = []
    for k in range(120):
        own = [rng.choice(pool) if rng.random() < 0.6 else fixture.sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(0, 14))]
        if rng.random() < 0.3:
            at = rng.randrange(0, 18)
            own += pool[at : at + 6]
        docs.append((k, rng.choice(["\n", "\n", " \n\n"]).join(own)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, docs[3][1]), (504, "\n".join([pool[0]] * 40))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_lines int").repartition(4)
    for min_words in (12, 50):
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(df, min_words).collect()}
        assert got == plain_dedup(docs, min_words)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    rng = random.Random(1)
    text = "\n".join(fixture.sentence(rng, 30) for _ in range(3))
    rows = [(1, text), (1, text), (2, text), (None, "x"), (None, None), (3, "x\n" + text)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "-") for r in got) == sorted(
        [("1", text), ("1", text), ("2", "-"), ("None", "x"), ("None", "-"), ("3", "x")]
    )


def test_shortest_runs():
    assert line_dedup.shortest_runs([3, 1, 4, 9], 5) == ([3, 2, 2, 1], [0, 0, 2, 1])
    assert line_dedup.shortest_runs([], 5) == ([], [])


@pytest.mark.parametrize("doc_id", [None, 1])
def test_quality_of_awkward_rows(spark, doc_id):
    rows = [(doc_id, t, 5) for t in (None, "", "w1 " * 4, "the and of to in " + fixture.sentence(random.Random(2), 30))]
    got = quality_rules.quality_rules(spark.createDataFrame(rows * 2, "doc_id long, text string, n_words int"))
    assert [(r.n_words, r.base_failed, r.kept) for r in got.collect()] == 2 * [
        (0, True, False), (0, True, False), (4, True, False), (35, False, True)
    ]
    assert [r for r in got.limit(1).collect()][0].failed_rules[0] == "length"
