"""Extraction, decontamination, chat windows and personal data against brute force."""

import hashlib
import math
import random
import re
from itertools import product

import public_tokenizers
import pytest
from fixtures import awkward, awkward_texts, docs_of, empty
from pyspark.sql import functions as F

from saleloom.llm import chat, decontam, html_extract, pii

PATH = public_tokenizers.path("word_bpe_49k.json")

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for all of you who read it.</p></div>
<div id="wrap"><article><h1>Title &amp; more</h1><p>First <b>para</b>graph,\n  with&nbsp;white   space<br>and a break.
<p>Short.<p>of<div class="ad">Buy now the best pills, cheap and good, from us only today and never again!</div>
<p>Last &lt;tag&gt; &copy; &#233;.</p></article><aside>Read also the other posts on this site, they are good and liked.</aside>
<form><label>Name</label><input><button>Send it</button></form>
<section id="comments"><article><p>Great post, I really like what you wrote here, thanks for sharing it with us!</p></article></section>
</div><footer>&copy; me, all rights reserved</footer>"""
TEXT = "Title & more First paragraph, with white space and a break. Short. of Last <tag> © é."


def test_main_text():
    assert html_extract.main_text(PAGE) == TEXT


PROSE = "Full paragraphs of prose stand here, long enough to be taken for an article by anyone who reads them at all. " * 3


@pytest.mark.parametrize("page", [
    "<body><main class='has-sidebar'><p>{}</p></main></body>", "<article class='post tag-food tags'><p>{}</p></article>",
    "<div class='search-result content'><p>{}</p></div>", "<article><div class='comment-on-policy'><p>{}</p></div></article>",
    "<article><p>{}</p><![foo[bar]]><![ x]></article>", "<main id=sidebar-main class=widget><p>{}</p></main>"])
def test_names_cost_no_article(page):
    assert html_extract.main_text(page.format(PROSE)) == PROSE.strip()


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "footer-content", "cookie_banner wide", "ad-slot", "comment-list", "nav main-menu"])
def test_names_speak_against(name):
    page = f"<body><div class='{name}'><p>{PROSE}</p></div><article><p>{PROSE} Only this.</p></article></body>"
    assert html_extract.main_text(page) == f"{PROSE} Only this.".replace("  ", " ")


def test_formulas_and_objects_are_read():
    page = f"<article><p>{PROSE} so <math><mi>E</mi>=<mi>m</mi></math> and <object>a map</object>.</p></article>"
    assert html_extract.main_text(page).endswith("so E=m and a map.")


def test_no_page_stops_the_job():
    rnd = random.Random(5)
    bits = ["<![", "<!", "<!--", "-->", "]]>", "<?", "</", "<p>", "<div class='", "'>", '"', "<a href=x>", "&#x", "&#", "99999999", "&amp", "<script>",
            "</script>", "<title>", "text ", "\x00", "<table><tr><td>", "<![CDATA[", "[", "]", ">", "<", "=", "é", "😀", "<math>", "<br/>", "\n",
            "<!DOCTYPE", "<![if", "&", "0" * 13, "&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65;"]
    for _ in range(10_000):
        html_extract.main_text("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))))


def test_main_text_without_hints():
    para = "A paragraph of plain prose that is long enough to be one, with commas, and that ends in a full stop."
    page = (f"<html><body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>{para}</p><p>Yes.</p>"
            f"<p>{para}</p></div><div><a href=4>Imprint</a> | <a href=5>Contact</a></div></body></html>")
    assert html_extract.main_text(page) == f"{para} Yes. {para}"


@pytest.mark.parametrize("html", [None, "", "  ", "<p>", "<script>x", "<!-- <p>a</p> -->", "</p></div></article>", "<p", "&#0;<"])
def test_pages_without_text(html):
    assert html_extract.main_text(html).strip("�<") == ""


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 3000 + "<article><p>Some text in here.") == "Some text in here."
    page = "<article>" + "<p>Some text in here, it goes on.</p>" * 5000 + "</article>"
    assert html_extract.main_text(page) == " ".join(["Some text in here, it goes on."] * 5000)


def test_cut_is_the_least_one():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 7)
        scores = [rnd.choice([-3.0, -1.5, -0.5, 0.5, 1.0, 2.5]) for _ in range(n)]
        edges = [(a, b, rnd.choice([0.25, 1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]

        def cost(keep):
            own = sum(max(-s, 0) if k else max(s, 0) for s, k in zip(scores, keep))
            return own + sum(w for a, b, w in edges if keep[a] != keep[b])

        got = html_extract.source_side(scores, edges)
        assert cost(got) == pytest.approx(min(cost(k) for k in product([False, True], repeat=n)))


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "", "", 3)],
                                  "page_id long, url string, html string, text long")
    got = sorted(map(tuple, html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (3, "", "", 0)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def contamination_by_hand(docs, items, window=10):
    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + window]), set()).add(str(i) if i is not None else None)
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                if tuple(w[k:k + n]) in windows and k + n <= len(w):
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k:k + n])]
        names = sorted(names - {None})
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", broadcast)  # 0: the way for benchmarks of any size
    rows = awkward_texts()
    prose = dict(rows)
    items = [(1, prose[101]), (2, prose[8]), (10, "W1 the"), (3, None), (4, "..."), (5, "one two"), (5, "one two"),
             (6, prose[9][4000:4300]), (None, prose[102]), (7, "zz yy"), (8, "straße 日本語 😀 𝔘")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows)
    got = sorted(map(tuple, decontam.contamination_digests(docs, bench).collect()), key=str)
    want = contamination_by_hand(rows, items)
    assert got == want
    assert sum(x[-1] for x in want) > 5
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    assert decontam.contamination_digests(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination_digests(empty(spark), bench).count() == 0


def test_windows_of_turns():
    rnd = random.Random(3)
    for _ in range(300):
        turns = [(rnd.choice(["system", "user", "assistant", "a\\n\nb<|"]),
                  "".join(rnd.choice("ab<!|\n\\ im_end|>") for _ in range(rnd.randint(0, 40)))) for _ in range(rnd.randint(1, 30))]
        windows = list(chat.windows_of(turns, len, 200, 60))
        back, loss = [], []
        for w in windows:
            read = chat.read_turns(w["text"])
            if w["window"] and turns[0][0] == "system":
                assert read[0][:2] == turns[0]
            assert w["n_tokens"] == len(w["text"])
            assert w["n_tokens"] <= 200 or len(read) - w["repeated"] == 1
            back += [(r, t) for r, t, _, _ in read[w["repeated"]:]]
            loss += [chat.unescape(w["text"][s["start"]:s["end"]]) for s in w["loss"]]
        assert back == turns
        assert loss == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rnd = random.Random(9)
    rows = [(c, i, rnd.choice(["user", "assistant", "system"]), "word " * rnd.randint(0, 900)) for c in range(5) for i in range(rnd.randint(1, 40))]
    rows += [(9, 1, "user", None), (9, 1, "user", None), (9, 1, None, "b"), (9, None, "assistant", "<|im_end|>a"), (None, 1, "user", "x"),
             (None, 0, "assistant", " é😀")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.conversation_digests(frame, PATH, 500, 100).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for c, g in groups.items():
        g.sort()
        said = "".join(x for _, r, x in g if r == "assistant")
        want[c] = (len(g), sha("".join(f"{r}\n{x}\n" for _, r, x in g)), len(said), sha(said))
    assert got == want
    assert chat.conversation_digests(frame.limit(0), PATH).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans_by_hand(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and sum(
                        int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns():
    rnd = random.Random(5)
    for alphabet in ("ab@.1-", "0123.+ -()@a", "1234567890- +", "a@b.c@d.", "12.0255"):
        for _ in range(4000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert pii.base_spans(text) == spans_by_hand(text), text


def test_patterns_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 200_000):
        pii.base_spans(text)


def test_disclosive_terms(spark):
    rnd = random.Random(2)
    common = ["alpha", "beta", "gamma", "delta", "kappa"]

    def filler(n):
        return " ".join(rnd.choice(common) for _ in range(n))

    rows = [(i, filler(30)) for i in range(60)]
    rows += [(100 + i, f"{filler(9)} reach zorblax at x.y@mail.example.org {filler(9)}") for i in range(4)]
    rows += [(200, f"{filler(9)} zorblax stays here"), (300, "lone quibble 10.1.2.3 once"), (301, "lone quibble 10.1.2.3 once")]
    found = {r["doc_id"]: r for r in pii.find(docs_of(spark, rows)).collect()}
    for i in range(4):
        text = dict(rows)[100 + i]
        added = [text[s["start"]:s["end"]] for s in found[100 + i]["added"]]
        assert "zorblax" in added and not set(added) & set(common)
    assert not found[200]["added"]  # no entity there
    assert not found[300]["added"]  # two copies of one context are one witness
    assert not any(found[i]["added"] or found[i]["spans"] for i in range(60))
    clean = {r["doc_id"]: r for r in pii.sanitise(docs_of(spark, rows)).collect()}
    assert "zorblax" not in clean[100]["text"] and "[EMAIL]" in clean[100]["text"]
    assert clean[200]["text"] == dict(rows)[200]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())


def test_disclosive_terms_of_copied_passages(spark):
    """A passage copied into different documents, a term far from its entity, and an entity of every document."""
    rnd = random.Random(4)
    common = ["alpha", "beta", "gamma", "delta", "kappa"]

    def filler(n):
        return " ".join(rnd.choice(common) for _ in range(n))

    beside = "alpha beta gamma quorvex delta mail to p.q@mail.example.org or kappa beta alpha gamma delta"
    rows = [(i, filler(30)) for i in range(60)]
    rows += [(100 + i, f"{filler(20)} {beside} {filler(20)} quorvex {filler(9)}") for i in range(2)]
    rows += [(200 + i, f"farword {filler(40)} 10.1.2.3 {filler(40)}") for i in range(2)]
    found = {r["doc_id"]: r for r in pii.find(docs_of(spark, rows)).collect()}
    for d, term, times in ((100, "quorvex", 2), (101, "quorvex", 2), (200, "farword", 1), (201, "farword", 1)):
        text = dict(rows)[d]
        added = [text[s["start"]:s["end"]] for s in found[d]["added"]]
        assert added.count(term) == times and not set(added) & set(common)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, rows)).collect()}
    assert not any("quorvex" in t or "farword" in t for t in clean.values())
    everywhere = [(i, f"word{chr(97 + i)} at a.b@mail.example.org") for i in range(5)]
    assert not any(r["added"] for r in pii.find(docs_of(spark, everywhere)).collect())


def added_by_hand(rows):
    """Added spans of every text from counts of whole documents."""
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    per_text, n_term = {}, {}
    for t, ids in texts.items():
        spans = spans_by_hand(t)
        for w in {m[0].lower() for m in re.finditer(r"[^\W\d_]{2,}", t)}:
            n_term[w] = n_term.get(w, 0) + len(ids)
        names = set()
        for kind, a, b in spans:
            v = t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])
            names |= {(kind, v), ("domain", v.split("@")[-1]) if kind == "email" else ("net", v.rsplit(".", 1)[0]) if kind == "ip"
                      else ("issuer", v[:6]) if kind == "card" else ("prefix", v[:-4])}
        places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{2,}", t)
                  if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        per_text[t] = names, places
    total = len(rows)
    kind_of = {}
    for c in {c for names, _ in per_text.values() for c in names}:
        holding = [t for t, (names, _) in per_text.items() if c in names]
        n_c = sum(len(texts[t]) for t in holding)
        for w in {w for t in holding for _, _, w in per_text[t][1]}:
            both = [t for t in holding if any(x == w for _, _, x in per_text[t][1])]
            if len(both) < 2 or n_c == total:
                continue
            n_both = sum(len(texts[t]) for t in both)
            share = math.log2(n_both * total / (n_c * n_term[w])) / math.log2(total / n_c)
            if share >= pii.GENERALISE:
                kind_of[c, w] = "remove" if share >= pii.REMOVE else "generalise"
    out = {}
    for t, (names, places) in per_text.items():
        kinds = {w: max((kind_of[c, w] for c in names if (c, w) in kind_of), default=None) for _, _, w in places}
        out[t] = sorted((kinds[w], a, b) for a, b, w in places if kinds[w])
    return out


def test_added_spans_equal_counts_by_hand(spark):
    rnd = random.Random(9)
    words = ["w" + "".join(rnd.choice("abcdef") for _ in range(3)) for _ in range(150)]
    rows = []
    for i in range(260):
        body = [rnd.choice(words[:12] if rnd.random() < 0.7 else words) for _ in range(rnd.randint(5, 40))]
        if i % 3 == 0:
            k = rnd.randint(0, 5)
            j, value = rnd.choice(list(enumerate([f"u{i}@d{k}.example.org", f"10.0.{k}.{i % 250}", f"+1 555 {k:03d} {1000 + i}", "4111 1111 1111 1111"])))
            body.insert(rnd.randint(0, len(body)), value)
            if rnd.random() < 0.95:
                body.insert(rnd.randint(0, len(body)), f"hint{chr(97 + j)}{chr(97 + k)}")
        elif i % 12 == 1:  # the hint of some entities stands in other documents, too
            body.append(f"hint{rnd.choice('abc')}{rnd.choice('abc')}")
        rows.append((i, " ".join(body)))
    rows += [(500 + j, rows[3 * j][1]) for j in range(20)] + [(600, None), (601, "")]
    want = added_by_hand(rows)
    found = pii.find(docs_of(spark, rows)).collect()
    text = dict(rows)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in found}
    assert got == {d: want[t or ""] for d, t in rows}
    kinds = [k for spans in got.values() for k, _, _ in spans]
    assert kinds.count("remove") > 10 and kinds.count("generalise") > 10 and len(text) == len(found)


def test_terms_meet_entities_by_text(spark, monkeypatch):
    """Many texts of one entity, each pair of them with a term of its own: no text meets the terms of the others."""
    kept = {}

    def noted(df, name, stored=pii.stored):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(pii, "stored", noted)
    rows = [(i, f"{w} term{w}xy at u{i}@mail.example.org") for i in range(200) for w in ["".join(chr(97 + int(c)) for c in f"{i // 2:03d}")]]
    rows += [(1000 + i, "nothing here") for i in range(2000)]
    found = pii.find(docs_of(spark, rows)).filter("size(added) > 0").collect()
    assert len(found) == 200 and all(len(r["added"]) == 3 for r in found)
    assert kept["touched"].count() == 600  # 200 texts, three terms each


def test_untouched_texts_are_not_joined(spark):
    for text in ("a@b.c", "x 1.2.3.4", "4111-1111 1111 1111", "+1 (555) 010-1234", "._@-.-", "0001.002.03.4"):
        assert pii.base_spans(text) and spark.range(1).select(F.lit(text).rlike(pii.MAY_HOLD)).first()[0], text
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
             for alphabet in ("ab@.1-", "0123.+ -()@a", "1234567890- +", "12.0255") for _ in range(2000)]
    seen = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.col("t").rlike(pii.MAY_HOLD)).collect()
    assert all(may or not pii.base_spans(texts[i]) for i, may in seen)


def test_spans_table(spark):
    rows = awkward_texts()
    got = pii.span_digests(awkward(spark)).collect()
    want = [(d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans_by_hand(t)).encode()).hexdigest()) for d, t in rows]
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    clean = pii.sanitise(awkward(spark))
    assert clean.columns == awkward(spark).columns and clean.count() == len(rows)
    assert clean.filter("doc_id = 11").first()["text"] == "mail [EMAIL] or [PHONE], [IP] and [CARD] now"
    assert pii.span_digests(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0
