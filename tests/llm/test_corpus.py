"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from framewise.llm import chat, decontam, fertility, html, langid, licenses, packing, queries, resample, shingles, simhash, text, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _x string"


@pytest.fixture(scope="module")
def corpus():
    """Rows with copies, near copies, benchmark passages, nulls, empties, a long text and a repeated row."""
    rng = random.Random(3)
    words = {"en": "the of and house river stone light over under walk".split(), "de": "der die das und haus fluß stein licht über unter".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "ing"]) for _ in range(rng.randint(1, 80))), lang, "s", 1, 0.5, "x"))
    rows += [(200 + k, rows[k][1], "en", None, None, None, None) for k in range(10)]
    rows += [(300 + k, rows[k][1] + " tail", "de", None, None, None, None) for k in range(10)]
    rows += [(400, None, None, None, None, None, None), (401, "", "en", "", 0, None, None), (402, " \n ", "en", "", 0, None, None), (None, "no id here", None, None, None, None, None)]
    rows += [(403, "word " * 30000, "en", "s", 1, 1.0, "y"), (5, rows[5][1], "de", "s", 1, 0.5, "x"), (404, "Ünïcode ﬁ 中文字 １２   x", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def brute_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("max_windows", [1_000_000, 7])
def test_decontamination(spark, docs, corpus, max_windows):
    items = [("a", " ".join(corpus[3][1].split()[2:20])), ("b", "house"), ("c", None), ("d", ""), (None, corpus[7][1]), ("b", "HOUSE!"), ("e", corpus[9][1][:200])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(decontam.report(docs, bench, max_windows=max_windows)))
    want = []
    for doc, t, *_ in corpus:
        w = brute_words(t)
        hit, found = set(), set()
        for item, it in items:
            iw = brute_words(it)
            for k in range(max(1, len(iw) - 9)) if iw else ():
                win = iw[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found |= {item} - {None}
        want.append((-1 if doc is None else doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    clean = rows(decontam.decontaminate(docs, bench, max_windows=max_windows))
    assert len(clean) == len(corpus) and decontam.decontaminate(docs, bench).columns == docs.columns
    assert all(r["n_hit"] == 0 or r["n_items"] for r in rows(decontam.mark(docs.select("doc_id", "text"), bench.where("item_id is not null"), max_windows=max_windows)))
    kept = {r["doc_id"] for r in rows(decontam.decontaminate(docs, bench, remove="documents"))}
    assert kept == {None if d < 0 else d for d, *_, bad in want if not bad}


def brute_fp(t, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, d):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs, corpus):
    got = rows(simhash.near_duplicates(docs))
    fps = [brute_fp(r[1]) for r in corpus]
    comp = brute_components(fps, 3)
    least = {c: min((corpus[i][0] for i in range(len(comp)) if comp[i] == c and corpus[i][0] is not None), default=None) for c in comp}
    want = sorted((str(corpus[i][0]), f"{fps[i]:016x}", str(least[comp[i]])) for i in range(len(comp)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = rows(simhash.keep_one(docs))
    assert len(kept) == len(set(comp)) and {r["doc_id"] for r in kept} == set(least.values())


@pytest.mark.parametrize("max_node", [65536, 64, 8])
def test_hamming_links(spark, max_node):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = set(base)
    for b in base[:12]:  # dense clusters, chains and loners
        x = b
        for _ in range(60):
            y = (x if rng.random() < 0.5 else b) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            codes.add(y)
            x = y
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (c >> 63 << 64),) for c in codes], "fp bigint")
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, 3, max_node).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    want = brute_components(codes, 3)
    at = {c: i for i, c in enumerate(codes)}
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[find(at[a])] = find(at[b])
    assert len({(find(i), want[i]) for i in range(len(codes))}) == len(set(want)) == len({find(i) for i in range(len(codes))})
    roots = {r["node"]: r["root"] for r in text.components(spark.createDataFrame([(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in links], "a bigint, b bigint")).collect()}
    assert len(set(roots.values())) == len({w for i, w in enumerate(want) if want.count(w) > 1})


def test_chat(spark):
    t = chat.Template()
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "<\\|im_end|>", "<\\\\/s>", "[", "<<</s>", "[[INST]", "", "a\\", "<<SYS>><</SYS>>", "\\<|im_start|>"]
    for x in nasty:
        s = t.shield(x)
        assert t.unshield(s) == x and not any(c in s for c in t.controls)
        for y in nasty:
            assert t.read("".join(p for p, _ in [*t.segments("us\ner\\n" + x, y), *t.segments("assistant", x)])) == [("us\ner\\n" + x, y), ("assistant", x)]
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty[1]), (2, 0, "assistant", None), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in rows(chat.conversations(df.unionByName(chat.probe(spark))))}
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and got[-1]["valid"] and len(got) == 5
    assert got[1]["loss_sha256"] == hashlib.sha256(nasty[1].encode()).hexdigest() and got[1]["loss_chars"] == len(nasty[1])
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest() and got[3]["n_turns"] == 3
    assert chat.conversations(df.limit(0)).count() == 0
    for wrong in ({"controls": ("x",)}, {"close": "<|im_end|><", "controls": ("<|im_start|>", "<|im_end|><")}, {"mid": " "}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    args = (queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), {"<|endoftext|>": 50256})
    more = spark.createDataFrame([(900, "a<|endoftext|>b  c\n\n d "), (901, "x " * 5000)], "doc_id bigint, text string")
    for size in (100_000, 20):
        got = rows(packing.packed(docs.select("doc_id", "text").unionByName(more), *args, part_size=size))
        texts = [(r[0], r[1]) for r in corpus] + [(900, "a<|endoftext|>b  c\n\n d "), (901, "x " * 5000)]
        want = []
        for d, t in texts:
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            cuts = list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
            want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *cuts], cuts))]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        seqs = {}
        for r in got:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in seqs.values():
            end = 0
            for o, n in sorted(s):
                assert o == end
                end += n
            assert end <= 1024
    assert packing.packed(docs.select("doc_id", "text").limit(0), *args).count() == 0


@pytest.mark.parametrize("special", [{}, {"<|endoftext|>": 50256}])
def test_encoder_long_runs(special):
    """Texts that hold millions of like characters, against the vocabulary's own file."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = not special
    mine = packing.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), special)
    n = 3_000_000 if special else 150_000
    for x in (" " * n, "\n" * n, "a" * n, "x" + " " * n + "y  z", " \n\u3000" * (n // 3) + "1", "a " + "\t" * n + "<|endoftext|>" + " " * n + "<|endoftext|>b", "q" + " " * n + "\n", "\x1c" * n + " b"):
        assert mine.ids(x).tolist() == tok.encode(x, add_special_tokens=False).ids, x[:5]


def test_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(1, 20, rng.integers(0, 9))
        _, n = packing.best_fit(x, 20)
        least = packing.lower_bound(x, 20)
        best = len(x)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(x):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + x[i] <= 20:
                    place(i + 1, [*bins[:b], bins[b] + x[i], *bins[b + 1 :]])
            place(i + 1, [*bins, x[i]])

        place(0, [])
        assert least <= best <= n


def test_fertility(spark, docs, corpus):
    measured = fertility.measured(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), queries.vocabulary("piece_bpe_32k.model"), ["doc_id", "lang"])
    got = sorted(rows(fertility.judge(measured)), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    for r, (d, t, *_) in zip(got, sorted(corpus, key=lambda c: (str(c[0]), len((c[1] or "").split()))), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = {x for x in wins if wins.count(x) > 1} if len(wins) < 2000 else set(wins)
        rep = len({i + k for i, x in enumerate(wins) if x in many for k in range(5)})
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep), d
        assert r["base_failed"] == (len(w) < 10 or 100 * rep > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    odd = spark.createDataFrame([(k, "the house is over the river and under the stone " * 8 + str(k), "en") for k in range(60)] + [(99, "zqxj vkwp xqzt jjkq wvxz qqpz " * 5, "en")], "doc_id bigint, text string, lang string")
    verdict = {r["doc_id"]: r["outside"] for r in rows(fertility.judge(fertility.measured(odd, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), queries.vocabulary("piece_bpe_32k.model"), ["doc_id", "lang"])))}
    assert verdict[99] and not any(v for k, v in verdict.items() if k != 99)


def test_fallback_share():
    """The share counted from single-character pieces is the share of byte pieces that the vocabulary really emits, over many scripts."""
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    plain = {p for i in range(piece.get_piece_size()) if len(p := piece.id_to_piece(i)) == 1}
    rng = random.Random(2)
    blocks = [(0x21, 0x7E), (0xA1, 0x17F), (0x370, 0x3FF), (0x400, 0x4FF), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF), (0x10900, 0x10915), (0x1D400, 0x1D4FF)]
    for a, b in blocks * 3:
        x = "".join(chr(rng.randint(a, b)) for _ in range(60))
        want = sum(piece.is_byte(i) for i in piece.encode(x))
        assert sum(len(c.encode()) for c in x if c not in plain) == want, hex(a)


def test_verdicts_by_brute_force(spark):
    """Bands and verdicts of groups large enough to have their own, against numpy quantiles."""
    rng = random.Random(12)
    data = [(k, "ab"[k % 2], "LATIN", 100, 128, 0, round(rng.gauss(4 + k % 2, 0.3), 5), abs(rng.gauss(0, 0.01)), min(1.0, rng.gauss(0.8, 0.02))) for k in range(400)]
    names = "doc_id bigint, lang string, script string, n_words bigint, n_tokens bigint, n_repeat_words bigint, chars_per_token double, fallback_share double, entropy double"
    for n in (1, 7):
        got = {r["doc_id"]: r["outside"] for r in rows(fertility.judge(spark.createDataFrame(data, names).repartition(n)))}
        for g in "ab":
            of = [r for r in data if r[1] == g]
            for c, (m, floor) in enumerate(fertility.MEASURES.items()):
                q = np.percentile([round(r[6 + c], 3) for r in of], [25, 50, 75])
                for r in of:
                    assert (m in got[r[0]].split(",")) == (abs(r[6 + c] - q[1]) > max(floor, 2.5 * (q[2] - q[0]))), (m, r)


def test_fertility_judges_all(spark):
    """Rare length classes and scripts have bands too, in tables large and small."""
    row = lambda k, lang, script, n, c: (k, lang, script, n, n, 0, c, 0.0, 0.8)
    data = [row(k, "en", "LATIN", 200, 4.0) for k in range(40)] + [row(100, "en", "LATIN", 100_000, 1.0), row(101, "en", "LATIN", 90_000, 4.0)]
    data += [row(102, "xx", "THAI", 200, 1.0), row(103, None, "THAI", 5_000, 4.0), row(104, "xx", "THAI", 29, 1.0)]
    names = "doc_id bigint, lang string, script string, n_words bigint, n_tokens bigint, n_repeat_words bigint, chars_per_token double, fallback_share double, entropy double"
    for some in (data, data[30:]):  # the second holds fewer than min_group documents
        got = rows(fertility.judge(spark.createDataFrame(some, names)))
        assert len(got) == len(some) and {r["doc_id"] for r in got if r["outside"]} == {100, 102}
        assert set(got[0]) == {"doc_id", "lang", "script", "n_words", "n_tokens", "n_repeat_words", "chars_per_token", "fallback_share", "entropy", "base_failed", "outside", "kept"}


def test_language(spark, docs, corpus):
    net = langid.train(docs, queries.fold(3).isin(0, 2), per_lang=60, per_doc=4)
    assert net.names == ["de", "en"]
    x = np.stack([langid.pad(r[1].encode(), 0) for r in corpus[:50]])
    h, _ = net.pooled(x)
    z = h @ net.p["o"] + net.p["c"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.abs(net.predict(x) - z / z.sum(axis=1, keepdims=True)).max() < 1e-4  # looked up or multiplied
    got = [r for r in rows(langid.predict(docs, net)) if r["doc_id"] is not None]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (400, 401, 402))
    held = [r for r in got if r["doc_id"] < 120 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    many = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'b', 'a') as lang", "repeat('x y ', 50) as text")
    _, y, names = langid.sample_windows(many, queries.fold(3) >= 0, 50, 2)
    assert names == ["a", "b"] and (np.bincount(y) == 100).all()  # thinned by hash, then the first 50 documents of each
    assert {r["lang_pred"] for r in rows(langid.predict(docs.limit(5), langid.train(docs.limit(0), queries.fold(3) == 0)))} == {"und"}


def test_licenses(spark):
    t = {n: x[0] for n, x in licenses.TEMPLATES.items()}
    line = licenses.TEMPLATES["gpl-3.0"][1]
    data = [(1, "Intro é. " + t["mit"] + " End."), (2, t["apache-2.0"].replace("permissions and", "rights and").replace("  ", " ")), (3, "nothing of the kind " * 50), (4, None), (5, ""), (6, "x " + line.upper() + "\ny"), (7, t["bsd-3-clause"][: len(t["bsd-3-clause"]) // 3])]
    got = {r["doc_id"]: r for r in rows(licenses.report(spark.createDataFrame(data, "doc_id bigint, text string")))}
    assert got[1]["licenses"] == "mit" and got[1]["best_coverage"] == 1.0
    m = got[1]["matches"][0]
    assert data[0][1][m["start"] : m["end"]] == t["mit"].rstrip(".") and m["inserted"] == 0
    assert got[2]["licenses"] == "apache-2.0" and got[2]["n_matches"] == 1 and 0.9 < got[2]["matches"][0]["coverage"] < 1 and got[2]["matches"][0]["inserted"] == 1
    assert got[6]["licenses"] == "gpl-3.0" and all(got[k]["n_matches"] == 0 for k in (3, 4, 5, 7))
    assert licenses.report(spark.createDataFrame(data, "doc_id bigint, text string").limit(0)).count() == 0


def test_licenses_tell_apart():
    index = licenses.Index(licenses.TEMPLATES, 3, 3, 30)
    names = lambda x: [m[0] for m in index.matches(text.words_of(x), 0.8)]
    for name, texts in licenses.TEMPLATES.items():
        assert all(names(f"So it is. {x} And so on.") == [name] for x in texts), name
    assert names("Licensed under CC BY-NC-ND 4.0.") == ["cc-by-nc-nd-4.0"]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.") == ["cc-by-nc-sa-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0"]
    assert names("Not released under the MIT License.") == names("Licensed under the Apache License, Version 1.1.") == names("This is not licensed under CC BY 4.0.") == []
    assert names(licenses.TEMPLATES["apache-2.0"][0]) == ["apache-2.0"]
    assert names("Released under the MIT License. " * 40) == ["mit"] * 40
    assert names("Released under the truly well known MIT License.") == []  # three words put in


def test_licence_alignment():
    """Banded alignment against the full edit distance to every stretch of the text."""
    rng = random.Random(6)
    for _ in range(60):
        t = [rng.randrange(8) for _ in range(rng.randint(5, 40))]
        x = []
        for v in t:
            x += [] if (u := rng.random()) < 0.04 else [rng.randrange(8)] if u < 0.08 else [v, rng.randrange(8)] if u < 0.12 else [v]
        at = rng.randint(0, 9)
        x = [rng.randrange(8) for _ in range(at)] + x + [rng.randrange(8) for _ in range(rng.randint(0, 9))]
        d = [0] * (len(x) + 1)
        for i, v in enumerate(t):
            new = [i + 1]
            for j, w in enumerate(x):
                new.append(min(d[j] + (v != w), d[j + 1] + 1, new[j] + 1))
            d = new
        band = max(len(t), at) + 2
        edits, pairs = licenses.align(np.array(t), np.array(x), at, band)
        assert edits == min(d)
        assert all(t[i] == x[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(pairs) >= len(t) - edits


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>
<div class="promoBox">Buy now</div><div>Common block of the site</div><article class=post><h1>Head &amp; {n}</h1><p>First <b>bold</b>
 line<br>next<p>Second&nbsp;&eacute; {n}<!-- hidden --><ul><li>one<li>two</ul><div class="share-links">Share</div><aside>Side</aside><p>Same passage on all pages</p></article><section id=comments><p>Nice!</p></section><form><input><button>Go</button></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    pages = [(k, f"https://a.example/{k}", PAGE.format(n=k)) for k in range(8)] + [(20, "https://b.example/", "<p>Only text</p>"), (21, None, None), (22, "x", ""), (23, "https://c.example", "plain < words &amp; more"), (24, "https://a.example/z", "<div><div><p>broken <b>mark")]
    got = {r["page_id"]: r for r in rows(html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"), keep=["page_id", "url"]))}
    assert got[3]["text"] == "Head & 3\n\nFirst bold line next\n\nSecond é 3\n\none\n\ntwo\n\nSame passage on all pages"
    assert got[20]["text"] == "Only text" and got[21]["text"] == got[22]["text"] == "" and got[23]["text"] == "plain < words & more" and got[24]["text"] == "broken mark"
    wrapped = "<form id=aspnet><div class='page with-sidebar'><main class='has-sidebar'><p>Kept</p></main><div class=sidebar><p>Side</p></div></div><section class=comments><article><p>Nice</p></article></section><article class='related teaser'><p>Other</p></article></form>"
    assert html.main_text(wrapped, set()) == "Kept"
    bare = [(k, "https://d.example/", f"<body><div><span>Menu</span></div><div>Page {k} text</div></body>") for k in range(6)]
    for most in (16 << 20, 0):  # templates broadcast, or joined by a shuffle
        got = rows(html.extract(spark.createDataFrame(bare, "page_id bigint, url string, html string"), most_bytes=most))
        assert sorted(r["text"] for r in got) == [f"Page {k} text" for k in range(6)]


def test_html_counts(spark):
    """On pages whose markup names nothing, counts alone find menus, adverts and footers; the templates equal counts made by brute force."""
    rng = random.Random(9)
    word = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    page = lambda k, body: (k, f"https://u@Host.example:80/{k}?x", f"<body><div class=qa><ul>{''.join(f'<li><a href=/{word(1)}>{word(1)}</a>' for _ in range(rng.randint(3, 6)))}</ul></div><div class=qc>{word(6)}</div><div class=qd><h1>{word(4)}</h1>{body}<div class=qe><p>The same words of the house in every article</p></div></div><div class=qb>&copy; {word(5)}</div></body>")
    bodies = ["".join(f"<p>{word(40)}<p>The passage that two articles share" if j == 1 and k < 2 else f"<p>{word(60)}" for j in range(4)) for k in range(30)]
    data = [page(k, b) for k, b in enumerate(bodies)]
    want = {k: [x for x in re.findall(r"<(?:p|h1)>([^<]+)", h.split("qd>")[1]) if not x.startswith("The same")] for k, _, h in data}
    df = spark.createDataFrame([(*r, "mine", {"a": 1}) for r in data], "page_id bigint, url string, html string, host string, `a.b` map<string,int>")
    for how in ({}, {"most_bytes": 0}, {"names": False}):
        got = {r["page_id"]: r for r in rows(html.extract(df, **how))}
        assert all(r["text"].split("\n\n") == want[k] and r["host"] == "mine" and r["a.b"] == {"a": 1} for k, r in got.items())
    assert any(r["text"].split("\n\n") != want[r["page_id"]] for r in rows(html.extract(df, least_pages=10**9)))
    seen, where = {}, {}
    for k, _, h in data:
        for x in html.subtrees(h)[0]:
            seen[x["h"]] = seen.get(x["h"], 0) + 1
            where.setdefault(x["h"], x["kind"])
    brute = {h for h, n in seen.items() if where[h] == html.CONTENT and n >= 5}
    found = set(rows(html.templates(df))[0]["template"])
    assert brute <= found and all(seen[h] >= 5 for h in found) and rows(html.templates(df))[0]["host"] == "host.example"
    assert html.extract(df.limit(0)).count() == 0 and html.extract(df).columns == ["page_id", "url", "html", "host", "a.b", "text", "n_chars"]


def test_html_is_linear():
    import time

    for page in ("<i>" * 30000 + "</u>" * 30000, "<u><div>" + "<b>" * 30000 + "</u>" * 30000, '<a b="' * 60000, "<p>" * 30000, "<a b='" * 60000 + '<a c="', "<li>" * 30000, "<!--" * 60000):
        start = time.time()
        html.main_text(page, set())
        assert time.time() - start < 20


def test_toxicity(spark):
    rng = random.Random(1)
    plain, bad = [f"word{k}" for k in range(60)], ["idiot", "scum", "trash"]
    data, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        # an insult alone is harmless; an insult with a group mention is toxic
        y = k % 3 == 0
        w += [rng.choice(bad)] * (k % 3 != 2) + ["those"] * (k % 3 != 1)
        data.append((k, " ".join(rng.sample(w, len(w)))))
        labels.append((k, 1, int(y)))
    docs = spark.createDataFrame(data + [(None, None), (9000, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, lab, queries.fold(4).isin(0, 1, 3), epochs=60)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs, model))}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.5) == (k % 3 == 0) for k in held]) > 0.95
    assert 0 <= got[9000] <= 1
    assert {r["score"] for r in rows(toxicity.score(docs, toxicity.train(docs, lab.limit(0), queries.fold(4) == 0)))} == {0.0}


def test_resampling(spark):
    rng = random.Random(2)
    good, poor = [f"good{k}" for k in range(30)], [f"poor{k}" for k in range(30)]
    data = [(k, " ".join(rng.choice(good if k % 2 else poor) for _ in range(40))) for k in range(400)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = rows(resample.resample(docs, docs.where("doc_id < 200 and doc_id % 2 = 1"), fraction=0.4))
    picked = {r["doc_id"] for r in got if r["selected"]}
    assert len(picked) == int(402 * 0.4) and np.mean([k % 2 for k in picked]) > 0.95
    keys = sorted((r["key"] for r in got if r["n_grams"]), reverse=True)
    assert min(r["key"] for r in got if r["selected"]) == keys[len(picked) - 1]
    total, want = resample.counts(docs, 64, docs.where("doc_id < 9"))
    of = resample.Grams(64)
    assert (total == sum(np.bincount(of(t), minlength=64) for _, t in data)).all()
    assert (want == sum(np.bincount(of(t), minlength=64) for k, t in data if k < 9)).all()
    assert resample.resample(docs.limit(0), docs.limit(0)).count() == 0
    ratio = np.log((want + 1) / (want.sum() + 64)) - np.log((total + 1) / (total.sum() + 64))
    weight = {r["doc_id"]: r["log_weight"] for r in rows(resample.weigh(docs, ratio, 100, ["doc_id"]))}
    assert all(abs(weight[k] - (ratio[of(t)].mean() * 100 if t else 0)) < 1e-9 for k, t in data)


def test_resampling_draws_exactly(spark):
    """Repeated rows tie, and exactly k rows are drawn all the same."""
    data = [(k, f"word{k} and more words") for k in range(50)] + [(7, "the same row again")] * 50 + [(None, "no id")] * 5 + [(900, None)] * 5
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    for part in (0.0, 0.1, 0.33, 0.5, 0.95, 1.0):
        got = rows(resample.resample(docs, docs.where("doc_id < 9"), fraction=part))
        k = int(len(data) * part)
        picked = [r["key"] for r in got if r["selected"]]
        assert len(picked) == min(k, 105) and sorted(picked) == sorted((r["key"] for r in got if r["n_grams"]), reverse=True)[: len(picked)][::-1]


@pytest.mark.parametrize("values", [[1.0] * 9, [0.1, 0.1 + 2e-17, 0.1, 5.0, -3.0], list(range(-50, 50)), [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0, 1e300, -1e300]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    order = sorted(map(float, values), reverse=True)
    for k in range(1, len(order) + 1, max(1, len(order) // 9)):
        value, left = resample.kth_largest(df, "x", k)
        assert value == order[k - 1] and left == k - sum(v > value for v in order)
    assert resample.kth_largest(df, "x", 0) is None and resample.kth_largest(df, "x", len(order) + 1) is None


def test_repeated_ids(spark):
    """An id with most of the rows is learnt from once, and no label is lost."""
    rng = random.Random(3)
    plain = lambda n, ws: " ".join(rng.choice(ws) for _ in range(n))
    data = [(1, "the of and house river", "en")] * 3000 + [(k, plain(30, ["der", "die", "und", "haus"]), "de") for k in range(10, 60)] + [(k, plain(30, ["the", "of", "house"]), "en") for k in range(60, 90)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    x, y, names = langid.sample_windows(docs, queries.fold(3) >= 0, 20, 2)
    assert names == ["de", "en"] and (np.bincount(y) == 40).all()
    assert langid.sample_windows(docs, queries.fold(3) >= 0, 20, 2, most_langs=1)[2] == ["de"]
    labels = spark.createDataFrame([(k, k % 2) for k in (1, *range(10, 90))], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels, queries.fold(4) >= -1) is not None


def test_keep_one_columns(spark):
    """Columns of any name and type survive: clashing, dotted, maps."""
    data = [(k // 2, f"some words that make up text {k // 3}", "mine", "x", {"a": k // 2}, 1.5) for k in range(12)] + [(None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(data, "doc_id bigint, text string, _k1 string, uid string, `m.n` map<string,int>, fp double")
    for stage in (simhash.keep_one, shingles.keep_one):
        got = rows(stage(docs))
        assert stage(docs).columns == docs.columns and sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [0, 1, 3, 4] and len(got) == 5
        assert all(r["_k1"] == "mine" and r["uid"] == "x" and r["m.n"] == {"a": r["doc_id"]} and r["fp"] == 1.5 for r in got if r["doc_id"] is not None)
        assert stage(docs.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert decontam.report(none, bench).count() == 0 and {r["n_hit"] for r in rows(decontam.report(docs, bench))} == {0}
    assert simhash.near_duplicates(none).count() == 0
    enc = (queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), queries.vocabulary("piece_bpe_32k.model"))
    assert fertility.judge(fertility.measured(none, *enc, ["doc_id", "lang"])).count() == 0
    assert langid.predict(none, langid.train(none, queries.fold(3) == 0)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels, queries.fold(4) == 0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage on a table with a clashing column, against what the operators say one by one."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = "the of and house river stone light over under walk tree cloud".split()
    item = " ".join(rng.choice(words) for _ in range(14))
    data = []
    for k in range(200):
        t = " ".join(rng.choice(words) for _ in range(60)) + (" idiot scum trash moron" if k % 10 == 0 else "")
        data.append((k, t + (f" {item}" if k == 33 else ""), "en", "s", len(t), 0.1))
    data += [(300, data[7][1], "en", "s", 1, 0.1), (301, None, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
            kept[name] = {r["doc_id"]: r for r in rows(out)}
    assert not {k for k in kept["toxicity"] if k is not None and k < 200 and k % 10 == 0}
    assert 301 not in kept["language"] and set(kept["toxicity"]) - set(kept["language"]) <= {301}
    assert 300 not in kept["near_duplicates"] and 7 in kept["near_duplicates"]
    assert item not in kept["decontamination"][33]["text"] and kept["decontamination"][7]["text"] == data[7][1] and kept["decontamination"][7]["score"] == 0.1
    assert {r["doc_id"] for r in rows(out)} == set(kept["decontamination"])


def test_pipeline_near_copies(spark, tmp_path):
    """The stage against all pairs: planted copies of every similarity from 0.6 to 1, chains, groups and repeated rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    data = []
    for k in range(60):
        base = fresh(200)
        data.append((3 * k, " ".join(base)))
        for c in (1, 2):
            base = [*base]
            for at in rng.sample(range(5, 195), rng.randint(0, 7)):
                base[at] = fresh(1)[0]
            data.append((3 * k + c, " ".join(base)))
    group = fresh(100)
    data += [(500 + k, " ".join([*group[: 100 - k % 12], *fresh(k % 12)])) for k in range(40)]
    data += [(700, data[0][1]), (701, None), (702, ""), (703, "Two words"), (704, "two  WORDS"), (705, "two other"), (None, data[9][1]), (None, "none of these"), (706, "twice"), (706, "twice")]
    near = [shingles.shingles(t) for _, t in data]
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    far = 0
    for i, x in enumerate(near):
        for j in range(i):
            y = near[j]
            if not x and not y or x and y and 10 * len(x & y) >= 8 * len(x | y):
                up[max(find(i), find(j))] = min(find(i), find(j))
                far += simhash.fingerprint(data[i][1]) != simhash.fingerprint(data[j][1]) and (simhash.fingerprint(data[i][1]) ^ simhash.fingerprint(data[j][1])).bit_count() > 3
    want = {}
    for i, (d, _) in enumerate(data):
        want.setdefault(find(i), []).append(d)
    want = sorted(min(v, key=lambda d: (d is None, d or 0)) if any(d is not None for d in v) else -1 for v in want.values())
    assert far > 50  # pairs that fingerprints at distance 3 cannot link
    spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.without_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows(got)) == want


def test_licenses_spdx():
    index = licenses.Index(licenses.TEMPLATES, 3, 3, 30)
    names = lambda t: [m[0] for m in index.matches(licenses.words_of(t), 0.8)]
    for line, want in (("// SPDX-License-Identifier: MIT\nint main", ["mit"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]), ("SPDX-License-Identifier: CC-BY-NC-4.0", ["cc-by-nc-4.0"]), ("SPDX-License-Identifier: MIT-0", ["mit-0"]), ("SPDX-License-Identifier: AGPL-3.0-only", ["agpl-3.0"]), ("SPDX-License-Identifier: Apache-1.1", []), ("license identifier of the text", [])):
        assert names(line) == want


def test_licenses_bound_drops_no_match(monkeypatch):
    """What the bound on shared k-grams, words and telling words skips could not have matched: the same matches with every candidate aligned. Long runs of one licence stay cheap."""
    import random
    import time

    index = licenses.Index(licenses.TEMPLATES, 3, 3, 30)
    rng = random.Random(6)
    pool = [t for x in licenses.TEMPLATES.values() for t in x]
    texts = []
    for _ in range(25):
        words = []
        for _ in range(6):
            t = licenses.words_of(rng.choice(pool))
            rate = rng.choice([0, 0.05, 0.15, 0.25])
            words += [w if rng.random() > rate else rng.choice([b"filler", b"not", b"mit", b"2", b"the"]) for w in t if rng.random() > rate / 3] + [b"between"] * rng.randrange(4)
        texts.append(words)
    fast = [index.matches(w, 0.8) for w in texts]
    assert sum(map(len, fast)) > 60
    monkeypatch.setattr(licenses.Index, "possible", lambda self, ids, least: lambda t, at, band: True)
    assert fast == [index.matches(w, 0.8) for w in texts]
    monkeypatch.undo()
    words = licenses.words_of(max(licenses.TEMPLATES["mit"], key=len)) * 300
    start = time.perf_counter()
    assert [m[0] for m in index.matches(words, 0.8)] == ["mit"] * 300
    assert time.perf_counter() - start < 10
