from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from opalspan.llm import html_paths, line_quality, mil_quality, pii_disclosure

DOCS = "doc_id long, text string, source string, kept string, score string, spans string"
SF = "/root/testdata/sf0.01"


def by_rule(x):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda z: (z[1], pii_disclosure.KINDS.index(z[0])))


def test_base_spans():
    r = random.Random(1)
    for _ in range(5000):
        x = "".join(r.choices("ab1.@-+ (2ü", k=r.randint(0, 40)))
        assert pii_disclosure.base_spans(x) == by_rule(x)
    assert pii_disclosure.base_spans("a" * 50000 + "@") == []


def test_disclosure(spark):
    # one address in several contexts, always beside a word that stands nowhere else
    r = random.Random(2)
    noise = lambda: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(6))
    rows = [(k, f"{noise()} zanzibarian j.doe@example.com the {noise()}", "s") for k in range(5)]
    rows += [(10 + k, f"the {noise()} the", "s") for k in range(30)] + [(90, None, "s"), (91, "", "s")]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS)
    got = {x["doc_id"]: x for x in pii_disclosure.personal_spans(df).collect()}
    for d, x, _ in rows:
        spans = by_rule(x or "")
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
        words = [(x or "")[int(s) : int(e)] for k, s, e in (y.split(":") for y in got[d]["spans"].split(",") if y) if k == "term"]
        assert words == (["zanzibarian"] if spans else [])
    clean = {x["doc_id"]: x["text"] for x in pii_disclosure.sanitise(df).collect()}
    assert " [EMAIL TERM] [EMAIL] the " in clean[0] and clean[10] == rows[5][1] and clean[90] == ""
    assert pii_disclosure.personal_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_disclosure_copies(spark):
    # copies of a text are one document of evidence for the word, too
    r = random.Random(9)
    noise = lambda: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(6))
    texts = [f"{noise()} zanzibarian j.doe@example.com the {noise()}" for _ in range(4)] + [f"the {noise()} the" for _ in range(60)]
    rows = [(k, x) for k, x in enumerate([texts[0]] * 200 + texts)]
    got = pii_disclosure.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(":" in x["spans"] and "term:" in x["spans"] for x in got) == 204


def reveals(n_et, n_t, n_e, n):
    """At most one bit of the entity is left, at the lower end of Wilson's interval, and one bit or more is told."""
    p, z2 = n_et / n_t, 1.645**2
    low = (p + z2 / (2 * n_t) - math.sqrt(z2 * (p * (1 - p) / n_t + z2 / (4 * n_t * n_t)))) / (1 + z2 / n_t)
    return -math.log2(low) <= 1 and math.log2(n / n_e) + math.log2(low) >= 1


def quasi_identifiers(r, texts):
    """Texts with planted pairs: 20 people with an address and two words that stand only beside it (one of them in one
    other text too), among addresses met once and words of a skewed vocabulary. (texts, person -> words)"""
    rows, planted = [], {}
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(texts // 2)]
    noise = lambda: [vocabulary[int(len(vocabulary) * r.random() ** 3)] for _ in range(r.randint(5, 40))]
    for k in range(texts):
        w = noise()
        if k % 25 == 0:
            w.insert(r.randint(0, len(w)), f"once{k}@example.org")
        rows.append(" ".join(w))
    for p in range(20):
        own = [f"quasi{chr(97 + p)}one", f"quasi{chr(97 + p)}two"]
        planted[p] = set(own)
        for k in range(6):
            w = noise() + own + [f"person{p}@example.com"]
            r.shuffle(w)
            rows.append(" ".join(w))
        rows.append(" ".join([*noise(), own[1]]))
    return rows, planted


def test_disclosure_alike_at_every_size(spark):
    """Planted quasi-identifiers are found, with few other words, by one rule at every size; an entity met once shows
    nothing."""
    for texts in (300, 1000, 1500, 6000):
        rows, planted = quasi_identifiers(random.Random(texts), texts)
        got = pii_disclosure.personal_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
        shown = collections.defaultdict(set)
        for x in got:
            t = rows[x["doc_id"]]
            person = re.search(r"person(\d+)@", t)
            for kind, s, e in (y.split(":") for y in x["spans"].split(",") if y):
                if kind == "term":
                    assert person, t  # no word beside an address met once
                    shown[int(person[1])].add(t[int(s) : int(e)])
        every = sum(map(len, shown.values()))
        right = sum(len(shown[p] & planted[p]) for p in planted)
        assert right == 40 and right / every > 0.9, (texts, right, every)


def disclosed(texts):
    """(text, start, end) of every revealing word, straight from the definitions."""
    import regex

    words = lambda x: {w.lower() for w in regex.findall(r"\p{L}+", x) if len(w) > 1}
    different = sorted(set(texts))
    uses = []  # entity, context, text, [(term, start, end)]
    for x in different:
        spans = by_rule(x)
        for kind, s, e in spans:
            near = [*[m for m in regex.finditer(r"\p{L}{2,}", x[:s])][-8:], *[m for m in regex.compile(r"\p{L}{2,}").finditer(x, e)][:8]]
            own = [(m[0].lower(), m.start(), m.end()) for m in near if not any(a < m.end() and m.start() < b for _, a, b in spans)]
            if own:
                value = x[s:e].lower() if kind == "email" else x[s:e] if kind == "ip" else re.sub("[^0-9]", "", x[s:e])
                uses.append(((kind, value), tuple(t for t, *_ in own), x, own))
    n, n_t = len(different), collections.Counter(t for x in different for t in words(x))
    out = set()
    for entity in {u[0] for u in uses}:
        mine = [u for u in uses if u[0] == entity]
        n_e = len({u[2] for u in mine})
        for term in {t for u in mine for t in u[1]}:
            n_et, k = len({u[2] for u in mine if term in u[1]}), len({u[1] for u in mine if term in u[1]})
            if k >= 3 and reveals(n_et, n_t[term], n_e, n):
                out |= {(u[2], s, e) for u in mine for t, s, e in u[3] if t == term}
    return out


def test_disclosure_brute_force(spark):
    r = random.Random(12)
    common = ["the", "and", "of", "write", "call", "mail", "Über", "naïve", "cafe\u0301", "x"]
    rows = []
    for k in range(1500):
        w = [r.choice(common) for _ in range(r.randint(0, 12))]
        if k % 10 == 0:
            who = r.randrange(12)
            w.insert(r.randint(0, len(w)), f"Nick{chr(97 + who)}name u{who}@example.com" if r.random() < 0.7 else f"u{who}@example.com and 10.0.0.{who}")
        rows.append((k, " ".join(w)))
    rows += [(2000 + k, rows[10 * k][1]) for k in range(30)] + [(3000, None), (3001, "rare " * 3 + "word" + " " * 4000 + "seldom +1 202 555 0143 " + "." * 900 + "thing")]
    got = pii_disclosure.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    found = {(texts[x["doc_id"]], int(s), int(e)) for x in got for kind, s, e in (y.split(":") for y in x["spans"].split(",") if y) if kind == "term"}
    assert found == disclosed([t or "" for t in texts.values()]) and len(found) > 20


def disclosed_anywhere(texts):
    """(text, start, end) of every revealing word: all words of a text that are not in an entity are its context."""
    import regex

    different, uses = sorted(set(texts)), []  # uses: entity, text, [(term, start, end)]
    n, n_t = len(different), collections.Counter()
    for x in different:
        found = [(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"\p{L}{2,}", x)]
        n_t.update({t for t, *_ in found})
        spans = by_rule(x)
        own = [w for w in found if not any(a < w[2] and w[1] < b for _, a, b in spans)]
        for kind, s, e in spans if own else []:
            uses.append(((kind, x[s:e].lower() if kind == "email" else x[s:e] if kind == "ip" else re.sub("[^0-9]", "", x[s:e])), x, own))
    out = set()
    for entity in {u[0] for u in uses}:
        mine = {u[1]: u[2] for u in uses if u[0] == entity}
        context = {x: tuple(t for t, *_ in own) for x, own in mine.items()}
        n_e = len(mine)
        for term in {t for c in context.values() for t in c}:
            both = [c for c in context.values() if term in c]
            if len(set(both)) >= 3 and reveals(len(both), n_t[term], n_e, n):
                out |= {(x, s, e) for x, own in mine.items() for t, s, e in own if t == term}
    return out


def test_disclosure_anywhere(spark, monkeypatch):
    # a word that reveals an address stands in its text more than eight words away, and twice
    r = random.Random(21)
    common = ["the", "and", "of", "write", "call", "mail", "Über", "naïve", "x"]
    some = lambda n: [r.choice(common) for _ in range(n)]
    rows = []
    for k in range(1500):
        w = some(r.randint(0, 40))
        if k % 10 == 0:
            who = r.randrange(12)
            w = [f"Nick{chr(97 + who)}name", *some(r.randint(20, 60)), f"u{who}@example.com", "+1 202 555 0143" if k % 30 == 0 else "or", *w, *some(20), f"nick{chr(97 + who)}name", *["onlyhere"] * (k == 700)]
        rows.append((k, " ".join(w)))
    rows += [(2000 + k, rows[10 * k][1]) for k in range(30)] + [(3000, None), (3001, "u3@example.com 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = disclosed_anywhere([t or "" for _, t in rows])
    texts = dict(rows)
    assert len(want) >= 300 and any(x[s:e].startswith("N") for x, s, e in want) and any(x[s:e].startswith("n") for x, s, e in want)
    for few, often in ((pii_disclosure.FEW, pii_disclosure.FREQUENT), (0, 2), (pii_disclosure.FEW, 2000)):
        monkeypatch.setattr(pii_disclosure, "FEW", few)
        monkeypatch.setattr(pii_disclosure, "FREQUENT", often)
        got = pii_disclosure.personal_spans(df).collect()
        assert len(got) == len(rows)
        assert {(texts[x["doc_id"]], int(s), int(e)) for x in got for kind, s, e in (y.split(":") for y in x["spans"].split(",") if y) if kind == "term"} == want
    clean = {x["doc_id"]: x["text"] for x in pii_disclosure.sanitise(df).collect()}
    assert not any("nick" in t.lower() for t in clean.values())


def measures(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit)


def test_line_quality(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["\n", " ", "\t\n"]).join("".join(r.choices("ab#\x0b é", k=r.randint(0, 5))) for _ in range(r.randint(0, 60))), "h") for k in range(60)]
    own = lambda k: " ".join(chr(97 + k % 26) * (1 + k // 26) + chr(97 + i) for i in range(25))
    rows += [(100 + k, f"All  Rights {k} reserved\n{own(k)}", "site") for k in range(80)]
    rows += [(300, "all rights 7 reserved " * 1 + "\nall rights 12 reserved", "site"), (301, None, None), (302, "", "h"), (303, "wörd " * 5000, "h"), (304, f"All Rights 9 reserved\n{own(304)}", "other")]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS)
    got = {x["doc_id"]: x for x in line_quality.assess(df).collect()}
    for d, x, _ in rows:
        m = measures(x or "")
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == m
        assert got[d]["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
    assert got[100]["kept"] and got[100]["n_common_words"] == 4 and got[304]["n_common_words"] == 0 and not got[300]["kept"]
    left = {x["doc_id"]: x["text"] for x in line_quality.without_common_lines(df).collect()}
    assert left[105] == own(5) and left[304] == rows[-1][1]
    assert line_quality.assess(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_common_lines(spark):
    own = lambda k, n: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for i in range(n))
    line = "all rights are reserved here"
    rows = [(k, f"{line}\n{own(k, 25)}", "site") for k in range(80)]
    rows += [(100, "\n".join([line.title()] * 4 + [own(100, 12)]), "site"), (101, "\n".join([own(101, 25), line, line]), "site")]
    rows += [(102, rows[-2][1], "site"), (102, rows[-2][1], "site")]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS)
    got = {x["doc_id"]: x for x in line_quality.assess(df).collect()}
    left = {x["doc_id"]: x["text"] for x in line_quality.without_common_lines(df).collect()}
    for d, x, _ in rows:
        assert got[d]["n_words"] - got[d]["n_common_words"] == len(left[d].split())
    assert got[100]["n_common_words"] == 20 and got[102]["n_common_words"] == 20 and got[101]["n_common_words"] == 10


def test_common_lines_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"] or "") for r in docs.select("doc_id", "source", "text").collect()]
    norm = lambda y: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", y.lower())).strip(" ")
    lines = lambda x: [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    texts, count = collections.Counter(), collections.Counter()
    for h, x in {(h, x) for _, h, x in rows}:
        texts[h] += 1
        count.update({(h, norm(y)) for y in lines(x)})
    common = {k for k, n in count.items() if n >= 3 and n > 0.05 * texts[k[0]]}
    want = {d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in lines(x) if (h, norm(y)) in common) for d, h, x in rows}
    assert sum(v > 0 for v in want.values()) > 100
    assert {r["doc_id"]: r["n_common_words"] for r in line_quality.assess(docs).collect()} == want


PAGE = """<html><head><title>T</title><script>if (a < b) { "<p>x</p>" }</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, ok.</div>{open}<h1>A &amp; B</h1><p>First para, with <b>bold</b>&nbsp;text
 and more, so it is long enough.<br>Next line.<p>Second.<ul><li>one<li>two</ul><form>Name: <input></form><div class="ad">Buy!</div>{close}
<div id="comments"><p>I, too, have a comment, and it is long, with marks.</p></div><aside>Side</aside><footer>&copy;</footer></body></html>"""


def test_html(spark):
    want = "A & B\n\nFirst para, with bold text and more, so it is long enough. Next line.\n\nSecond.\n\none\n\ntwo"
    assert html_paths.main_text(PAGE.replace("{open}", "<article>").replace("{close}", "</article>")) == want
    assert html_paths.main_text(PAGE.replace("{open}", '<div id="content">').replace("{close}", "</div>"))== want
    # the paths decide: with all of them the page's other blocks come in
    every = "\n\n".join(b.text for b in html_paths.blocks(PAGE))
    assert "Menu" in every and "We use cookies" in every and "Menu" not in want
    found = html_paths.blocks(PAGE.replace("{open}", "<article>").replace("{close}", "</article>"))
    assert {b.path for b in found} - html_paths.content_paths(found)
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain < text", "x"), (4, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<div 'broken <p>ok", "x")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_paths.extract_main_text(df).collect()]
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "plain < text", 12), (4, "deep", 4)]


def test_html_paths_against_plain_sums():
    """Values of paths from the definition, node by node, and the choice from the values alone."""
    for page in (PAGE.replace("{open}", "<article>").replace("{close}", "</article>"), PAGE.replace("{open}", "").replace("{close}", ""), "<p>x<div><p>a. b, c<ul><li>one<li>two</ul><section><p>more text</section></div><td>q"):
        found = html_paths.blocks(page)
        ratio, calm = {}, {}
        for p in {b.path for b in found}:
            own = [b for b in found if b.path == p]
            n, size = len(own), sum(len(b.text) for b in own)
            calm[p] = sum(b.factor for b in own) / n * (1 - sum(b.linked for b in own) / size)
            ratio[p] = math.log(1 + size / n) * (1 + math.log(1 + sum(len(html_paths.PUNCTUATION.findall(b.text)) for b in own) / n))
        value = html_paths.ratios(found)
        assert value.keys() == ratio.keys()
        for p, v in value.items():
            smooth = []
            for i, b in enumerate(found):
                if b.path == p:
                    near = [(html_paths.KERNEL[k - i + 2], ratio[found[k].path]) for k in range(max(0, i - 2), min(len(found), i + 3)) if found[k].path[:-1] == p[:-1]]
                    smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            own = sum(smooth) / len(smooth)
            around = [own]
            for k in range(1, len(p)):
                if p[k - 1] not in ("html", "body"):
                    under = [b for b in found if len(b.path) > k and b.path[:k] == p[:k]]
                    around.append(sum(len(b.text) * ratio[b.path] for b in under) / sum(len(b.text) for b in under))
            assert abs(v - math.sqrt(own * max(around)) * calm[p]) < 1e-9 * max(1, v)
        assert html_paths.content_paths(found) == {p for p, v in value.items() if v >= 0.2 * max(value.values()) and v > 0.01}


def test_html_values_decide(spark, monkeypatch):
    """Without marks, length and punctuation cut menus; with values made constant nearly every page changes."""
    text = html_paths.main_text
    long = "A sentence, with marks, that goes on for a while. " * 4
    menu = "".join(f"<li>topic {k}" for k in range(12))
    plain = f"<body><div class=left><ul>{menu}</ul></div><div class=text><h2>Head</h2><p>{long}<p>Short.<p>{long}<ul><li>one<li>two</ul></div><table><tr><td>12<td>13</table>"
    assert text(plain).split("\n\n") == ["Head", long.strip(), "Short.", long.strip(), "one", "two"]
    # in one container with the text, unlinked and without names
    mixed = f"<body><div><p>Home Products About Contact</p><h1>Head</h1><p>{long}</p><p>{long}</p><ul><li>Terms</li></ul><div>\u00a9 2024 Example, Inc. All rights reserved.</div></div>"
    assert text(mixed).split("\n\n") == ["Head", long.strip(), long.strip()]
    # an article may say such things
    assert text(f"<article><p>{long}<p>All rights reserved.<p>Copyright law<p>About us</article>").count("\n\n") == 3
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    before = [text(x) for x in pages]
    real = html_paths.ratios
    monkeypatch.setattr(html_paths, "ratios", lambda found: dict.fromkeys(real(found), 1.0))
    assert sum(text(x) != y for x, y in zip(pages, before)) > 0.9 * len(pages)
    monkeypatch.setattr(html_paths, "ratios", lambda found: {b.path: b.factor * (1 - b.linked / len(b.text)) for b in found})
    assert text(plain) != "" and "topic 3" in text(plain) and "12" in text(plain)  # the factors alone keep them


def test_html_shapes():
    text = html_paths.main_text
    long = "A sentence, with marks, that goes on for a while. " * 4
    items = "".join(f"<li>item {k}" for k in range(10))
    page = f"<body><div class=menu><a href=x>one</a> <a href=y>two</a></div><div id=content><h2>Head</h2><p>{long}<p>{long}<p>{long}<ul>{items}</ul><table><tr><td>a<td>b</table></div><div class=footer>Terms, and more.</div>"
    assert text(page).split("\n\n") == ["Head", *[long.strip()] * 3, *[f"item {k}" for k in range(10)], "a", "b"]
    linked = f"<body><div id=content><p>{long}<p>{long}<ul><li><a href=x>More to read here</a><li><a href=y>And here</a></ul></div>"
    assert text(linked).split("\n\n") == [long.strip()] * 2
    comments = f"<main><article><p>{long}</article><section class=comments>" + f"<article><p>{long}</article>" * 5 + "</section></main>"
    assert text(comments) == long.strip()
    assert text("<div>" * 5000 + "x" + "<b>" * 5000 + "<p>y" * 100).count("y") == 100 and text(None) == text("") == ""


def test_quality_gradients():
    r = random.Random(4)
    bags = [mil_quality.passages("".join(r.choices("abc ,.#\n", k=k))) for k in (10, 700, 1500, 0)]
    m, y = mil_quality.Model(), np.array([1, 0, 1, 0], dtype=np.float64)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, sizes = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags])
    run = lambda: m.forward(x, np.cumsum(sizes) - sizes, sizes)
    for bag, s in zip(bags, run()["s"]):  # one document by loops
        h = np.tanh(bag @ m.p["W"] + m.p["d"])
        e = [float((np.tanh(q @ m.p["V"]) * (1 / (1 + np.exp(-(q @ m.p["U"]))))) @ m.p["w"][:, 0]) for q in h]
        a = np.exp(e) / np.exp(e).sum()
        assert abs(1 / (1 + np.exp(-(float((a @ h) @ m.p["c"][:, 0]) + m.p["b"][0, 0]))) - s) < 1e-9
    loss = lambda: float(-np.mean(y * np.log(run()["s"]) + (1 - y) * np.log(1 - run()["s"])))
    for name, g in m.gradients(run(), y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        m.p[name][at] += 1e-5
        up = loss()
        m.p[name][at] -= 2e-5
        down = loss()
        m.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), name


def test_quality_sample(spark):
    """Training sees what scoring sees: all passages of long texts; ids that stand twice count once; bounds hold."""
    long = "Some words, then more. " * 4000
    rows = [(k, long[: 512 * (k % 7 + 1)] if k else long) for k in range(60)] + [(3, "again"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, None), (None, 1)], "doc_id long, quality int")
    bags, y = mil_quality.sample(docs, labels)
    learn = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert len(bags) == len(y) == len(learn)
    sizes = sorted(len(b) for b in bags)
    assert sizes == sorted(1 if k == 3 else -(-len(dict(rows[:60])[k]) // 512) for k in learn)
    if 0 in learn:
        assert np.allclose(max(bags, key=len), mil_quality.passages(long), atol=2e-3)
    few, _ = mil_quality.sample(docs, labels, 10, 30)
    assert 0 < len(few) <= 10 and (len(few) == 1 or sum(map(len, few)) <= 30)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = mil_quality.fit(docs, labels)
    rows = mil_quality.score(docs, model).join(labels, "doc_id").where(mil_quality.fold(F.col("doc_id")) == 0).select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.9
    odd = spark.createDataFrame([(1, None, "s", "", "x", ""), (1, "", "s", "", "x", ""), (None, "word " * 20000, "s", "", "x", "")], DOCS)
    assert all(0 <= r["score"] <= 1 for r in mil_quality.score(odd, model).collect())
    none = mil_quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r["score"] for r in mil_quality.score(odd, none).collect()} == {0.5}
