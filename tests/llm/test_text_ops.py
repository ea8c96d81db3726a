"""Chat, decontamination, language, quality, extraction: pure parts and brute force."""

import hashlib
import html
import json
import zlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import chat, decontaminate, html_text, language, queries, quality
from lexiloom.llm.common import table

TEXTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\\", "[INST]", "[", "/INST]", "</s>", "s>", "\n", "a", " ", "é", "🙂", "|"]), max_size=30).map("".join) | st.text(max_size=30)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=6))
@settings(max_examples=300, deadline=None)
def test_format_round_trip(turns):
    formatted, loss = chat.format_turns(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:  # inside texts no control string is left
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
    assert formatted.count(chat.START) == len(turns)


def test_op2_query_is_plain_python(spark, sf_dir):
    """The whole query against a direct account of the table; all layouts occur."""
    sf = sf_dir.replace("0.001", "0.01")
    turns = {}
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op2_chat_fingerprints(spark, sf).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(turns)
    for k, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
        assert got[k].formatted_chars == len(chat.format_turns(own)[0])
    assert {r.layout for r in got.values()} == {"prompt_response", "system_prompt_response", "conversations", "messages"}


def test_fields_beside_the_turns_do_not_count():
    assert chat.canonical({"id": 7, "meta": {"a": [1]}, "prompt": "q", "response": "a"})[0] == "prompt_response"
    assert chat.canonical({"prompt": "q", "response": "a", "other": 1}) == ("", None)


def test_layouts_become_the_same_turns():
    want = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}):
        assert chat.canonical(record)[1] == want, record
    assert chat.canonical({"instruction": "q", "input": "i", "output": "a"})[1][0] == ("user", "q\n\ni")
    assert chat.canonical({"strange": {"x": [1]}}) == ("", None)


def test_unknown_and_broken_records(spark):
    rows = [(1, '{"strange": 1}'), (2, "not json"), (3, None), (4, json.dumps({"prompt": "p", "completion": "c"}))]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["unknown", "unknown", "unknown", "ok"]
    read = {r.conv_id: r for r in chat.digests(chat.format_records(spark.createDataFrame(rows, "id long, record string"))).collect()}
    assert [(read[i].status, read[i].n_turns) for i in (1, 2, 3, 4)] == [("unknown", None)] * 3 + [("ok", 2)]


def brute_hits(texts, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for name, item in items:
            v = cut(item)
            m = min(window, len(v))
            for i in range(len(v) - m + 1 if v else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == v[i : i + m]:
                        hit.update(range(k, k + m))
                        found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_search_is_brute_force():
    r = random.Random(5)
    vocabulary = ["Aa", "b", "ć", "d1", "e"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    for window in (1, 2, 3, 5):
        items = [(str(i), make(r.randint(0, 9))) for i in range(12)]
        texts = [make(r.randint(0, 60)) for _ in range(40)]
        searcher = decontaminate.Searcher(items, window)
        got = [(n, sum(b - a for a, b in runs), names) for n, runs, names, _ in map(searcher.find, texts)]
        assert got == brute_hits(texts, items, window)


def test_blocks_of_the_benchmark_agree(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")
    one, many = (sorted(tuple(x) for x in decontaminate.judged(decontaminate.search(docs, bench, n)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()) for n in (10**9, 3000))
    assert one == many and any(x[2] for x in one)


def test_op3_query_is_brute_force(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = table(spark, sf_dir, "documents", "doc_id", "text").orderBy("doc_id").collect()
    hot = [d for d in docs if d.doc_id % 7 == 0]
    got = {r.doc_id: r for r in queries.op3_wu_manber(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, (n, hit, names) in zip(hot, brute_hits([d.text for d in hot], items), strict=True):
        g = got[d.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(names), hit > 0 and 20 * hit >= n)


def test_forward_sums_all_segmentations():
    pieces = sorted(["a", "b", "ab", "ba", "aba", language.MARK + "a", language.MARK])
    lattice = language.Lattice(pieces)
    p = language._with_tail(np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T)

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            head = word[:n]
            chance = p[pieces.index(head), k] if head in pieces else language.FOREIGN if n == 1 else 0.0
            out += chance * total(word[n:], k)
        return out

    for word in ["a", "ab", "▁aba", "abab", "xaby", "▁ababab"]:
        got = language.word_log_probs(lattice, p, [word])[0]
        assert np.allclose(got, [np.log(total(word, k)) for k in (0, 1)])


def test_language_held_out(spark, sf_dir):
    got = queries.op1_marginal_unigrams(spark, sf_dir).join(table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_op1_query_is_brute_force(spark, sf_dir):
    """Every prediction of the query from plain sums over segmentations, word by word."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    path, langs, p = language.train(docs)
    pieces = {x: k for k, x in enumerate(language.read_pieces(path))}
    longest = max(map(len, pieces))
    known = {}

    def word(w):
        if w not in known:
            sums = [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in w]
            for j in range(1, len(w) + 1):
                for i in range(max(0, j - longest), j):
                    k = pieces.get(w[i:j])
                    if k is not None or j == i + 1:
                        sums[j] += sums[i] * (p[k] if k is not None else language.FOREIGN)
            known[w] = np.log(sums[-1])
        return known[w]

    got = {r.doc_id: r for r in queries.op1_marginal_unigrams(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        ws = language.words_of(r.text)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not ws:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        total = sum(word(w) for w in ws)
        assert g.lang_pred == langs[int(np.argmax(total))] and np.isclose(g.score, 1 / np.exp(total - total.max()).sum())


def test_op8_query_is_brute_force(spark, sf_dir):
    """Training rows and scores of the query from plain loops; only fit() is shared."""
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    marks = [(r.doc_id, r.quality) for r in table(spark, sf_dir, "labels").collect() if r.quality in (0, 1) and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5]
    learned = sorted((q, quality.figures(docs[i])) for i, q in marks)
    model = quality.fit(np.array([f for _, f in learned]), np.array([q for q, _ in learned], float))
    got = {r.doc_id: r for r in queries.op8_additive_model(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        f = quality.figures(t)
        at = [sum(1 for e in edges if x >= e) for edges, x in zip(model.edges, f, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[a], at[b]] for a, b, t in model.pairs)
        score = 1 / (1 + np.exp(-total))
        assert np.isclose(got[i].score, score) and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op9_query_is_brute_force(spark, sf_dir):
    """All pages: the text of their article element, cut by hand."""
    blocks = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|div|article|section|table|tr|td|th|blockquote|pre|dl|dt|dd|figure|figcaption)\b[^>]*>", re.I)
    got = {r.page_id: r for r in queries.op9_host_paths(spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article\b[^>]*>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", inner, flags=re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in blocks.split(inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = queries.op8_additive_model(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert np.mean([r.quality == r.predicted for r in out]) > 0.95


def test_gam_finds_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="Cookie-Notice">We use cookies</div>
<div class="wrap c12"><article class="post-7"><h2>Head &amp; shoulders</h2><p>First   line<br>goes on<p>Second <b>bold</b> &#8212; end
<div class="ad">Buy</div><ul><li>one<li>two</ul><form><input>Search</form></article><div id="comments"><p>Reader says</p></div></div>
<aside>More</aside><footer>&copy; me</footer>"""


def test_extraction_of_one_page():
    page = html_text.Page(PAGE)
    k = page.best()[0]
    assert page.path(k) == "/html/body/div.c0.wrap/article.post-0" and page.find(page.path(k)) == k
    assert page.text(k) == "Head & shoulders\nFirst line goes on\nSecond bold — end\none\ntwo"


def test_hosts_vote(spark):
    good = "<body><div class='x'><p>{}</p></div><div class='main{}'><p>{}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", good.format("short", i, "the long text " * 9)) for i in range(6)]
    rows.append((9, "http://H.org/odd", good.format("a much longer side text " * 30, 9, "brief main text")))
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == "brief main text" and got[0].path == "/body/div.main0"
