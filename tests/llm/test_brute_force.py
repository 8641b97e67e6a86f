"""Every operator against a plain recomputation on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corpusloom.llm import chunking, crf, decontam, density, langid, licenses, packing, pii, ppm, queries, simhash

SF = "/root/testdata/sf0.001"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: queries.QUERIES[name](spark, SF).collect()


def test_packing(result, texts_by_id):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in result("op1_harmonic_packing"):
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert pieces.keys() == texts_by_id.keys()
    for doc_id, text in texts_by_id.items():
        ids, at = [*slow.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids))
            at += r.length
        assert at == len(ids)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        kinds = {packing.reciprocal_class(r.length) for r in rows}
        assert len(kinds) == 1 and (kinds == {32} or len(rows) <= kinds.pop())
    full = sum(r.length for rows in bins.values() for r in rows)
    assert full / (len(bins) * 1024) > 0.85  # one open bin per class weighs much in so small a table


def test_packed_ids_round_trip(spark, docs):
    pieces = packing.pack(docs.limit(20), keep_ids=True)
    for r in packing.sequences(pieces).collect():
        assert len(r.ids) == 1024 or len(r.ids) & (len(r.ids) - 1) == 0
    whole = {r.doc_id: r.ids for r in pieces.where("start = 0").collect()}
    _, fast = packing._encoders("byte_bpe_50k")
    for doc_id, text in docs.limit(20).select("doc_id", "text").collect():
        assert fast.decode(list(whole[doc_id])[:5]).rstrip("!") in text + "!"


@pytest.mark.parametrize("text", ["", "it's  é \x85 x y\n\n z", "<|endoftext|> a", "日本 ١٢ ǅ ȿ͸", "a\x1cb\x0b", "œuvre ½ ²³"])
def test_encoders_agree(text):
    slow, _ = packing._encoders("byte_bpe_50k")
    assert packing.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\x85"])
def test_encoding_of_a_very_long_blank_run(space):
    slow, _ = packing._encoders("byte_bpe_50k")
    text = "word" + space * 1_000_000 + "x"
    assert packing.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    def luhn(d):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(v // 10 + v % 10 for v in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii(result, texts_by_id):
    for r in result("op2_offset_pii"):
        base = plain_base(texts_by_id[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
        ("é jane at example dot com", "email", "jane at example dot com"),
        ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("＋１ (499) 555-6503 ok", "phone", "＋１ (499) 555-6503"),
        ("card four" + " one" * 15 + " end", "card", "four" + " one" * 15),
        ("at 192[.]168[.]1[.]20 x", "ip", "192[.]168[.]1[.]20"),
        ("j​аne@exa​mple.com", "email", "j​аne@exa​mple.com"),
    ],
)
def test_disguised(text, kind, source):
    base, added = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in added] == [(kind, source)]
    assert source not in pii.redacted(text) and f"<{kind.upper()}>" in pii.redacted(text)


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("аlice@example.com", "email"), ("аliсe@example.com", "email"), ("alice@example.cоm", "email"),
        ("alice@example.co dot uk", "email"), ("192.168.1.1２", "ip"), ("+44 20 7946 09 five eight nine", "phone"),
        ("4111 1111 1111 1111 zero zero three", "card"),
    ],
)
def test_disguise_beside_a_base_fragment(source, kind):
    text = f"see {source}, ok"
    base, added = pii.find(text)
    assert base and (kind, 4, 4 + len(source)) in added
    assert pii.redacted(text) == f"see <{kind.upper()}>, ok"


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("plus 44 20 7946 0958", "phone"), ("plus one 415 555 0100", "phone"), ("plus four nine 151 2345678", "phone"),
        ("+four nine 151 2345678", "phone"), ("+44 20 7946 095 eight", "phone"), ("plus 44 two zero 7946 0958", "phone"),
        ("plus vier neun drei null fünf fuenf zwo eins drei vier", "phone"), ("plus trois trois un zéro cinq un six un un huit", "phone"),
        ("one nine two dot one six eight dot zero dot one", "ip"), ("10 dot zero dot zero dot one two", "ip"),
        ("alice at mail.example dot com", "email"), ("alice at mx.mail.example (dot) com", "email"),
    ],
)
def test_disguises_of_few_words(source, kind):
    text = f"see {source}, ok"
    assert (kind, 4, 4 + len(source)) in pii.find(text)[1]
    assert pii.redacted(text) == f"see <{kind.upper()}>, ok"


def test_few_words_add_nothing_to_prose():
    for text in ("one of 12 or two. 1999. One, plus one", "bob@example4.one two", "12 one two@example.com", "call +44 20 7946 0958. One more", "au +1 (848) 555-1373 Un an"):
        assert pii.find(text)[1] == []
    card = "one " + "".join(chr(0xFF10 + int(d)) for d in "4111111111111111")
    assert ("card", 4, 20) in pii.find(card)[1]


def test_base_cases():
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@y@z.w", "999.1.1.1 1.1.1.256", "4111 1111-1111 1111 1", "+1 2345678 +12"):
        assert pii.detect(text) == plain_base(text)


def test_chunks(result, texts_by_id):
    order = sorted(texts_by_id)
    rows = {r.doc_id: r for r in result("op3_content_chunks")}
    assert rows.keys() == texts_by_id.keys()
    for k, doc_id in enumerate(order):
        text, after = texts_by_id[doc_id], texts_by_id[order[(k + 1) % len(order)]]
        swap = len(text) // 4
        changed = text[: len(text) - swap] + after[:swap]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == chunking.as_fingerprint(chunking.chunk_set(text))
        assert r.near_next == chunking.containment(chunking.chunk_set(text), chunking.chunk_set(after))
        if len(text) > 1000:
            assert r.near_edited > 0.4


def test_chunks_shift():
    text = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:7] for k in range(2000))
    ends = chunking.boundaries(text.encode())
    assert ends[-1] == len(text) and max(np.diff([0, *ends])) <= chunking.LARGEST
    assert chunking.containment(chunking.chunk_set(text), chunking.chunk_set("shift " + text)) > 0.95
    gear, rolled = chunking.GEAR, 0
    for b in text.encode()[:100]:
        rolled = ((rolled << 1) + int(gear[b])) & 0xFFFFFFFF
    assert int(chunking._rolled(np.frombuffer(text.encode()[:100], np.uint8))[-1]) == rolled


def shingles(text, width=5):
    words = re.findall(r"\w+", text.lower().replace("_", " "))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_containment(spark, result, texts_by_id):
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = {}
    for doc_id, text in texts_by_id.items():
        own = shingles(text)
        for item, wanted in items.items():
            if len(own & wanted) >= 0.8 * len(wanted):
                expected[doc_id, item] = len(own & wanted)
    assert {(r.doc_id, r.item_id): r.n_shared for r in result("op4_containment_search")} == expected
    assert expected


def test_containment_of_short_and_partial_items(spark):
    words = [f"w{k}" for k in range(40)]
    benchmark = spark.createDataFrame([(1, "Two words"), (2, " ".join(words)), (3, ""), (4, None), (None, "x y")], "item_id long, text string")
    rows = [(1, "here are two, words."), (2, "x " * 500 + " ".join(words[:34]) + " y" * 500), (3, " ".join(words[:30])), (4, "two other words"), (5, None)]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in found.collect()} == {(1, 1, 1), (2, 2, 30)}


def test_ppm(result, texts_by_id):
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()), b""] for i, t in texts_by_id.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 5 != 1 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for r in result("op5_ppm_score"):
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(r.doc_id) % 5 == 1, len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def plain_ppm(training, text, order):
    """Log10 probability of a text, symbol by symbol with explicit exclusion sets."""
    table = defaultdict(Counter)
    for t in training:
        data = [ppm.START] * order + list(t) + [ppm.END]
        for k in range(order, len(data)):
            for size in range(order + 1):
                table[tuple(data[k - size : k])][data[k]] += 1
    total, data = 0.0, [ppm.START] * order + list(text) + [ppm.END]
    for k in range(order, len(data)):
        excluded = set()
        for size in range(order, -1, -1):
            seen = {s: n for s, n in table.get(tuple(data[k - size : k]), {}).items() if s not in excluded}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[k] in seen:
                total += math.log10(seen[data[k]] / whole)
                break
            total += math.log10(len(seen) / whole)
            excluded |= set(seen)
        else:
            total -= math.log10(max(1, ppm.SYMBOLS - len(excluded)))
    return total


@pytest.mark.parametrize("model_rows", [ppm.MODEL_ROWS, 300])
def test_ppm_against_sets(spark, docs, texts_by_id, model_rows):
    few = [i for i, t in sorted(texts_by_id.items()) if len(t) < 600][:25]
    training = [ppm.lowered(texts_by_id[i]) for i in few if crc(i) % 5 != 1]
    table = docs.where(docs.doc_id.isin(few))
    for r in ppm.score(table, model_rows).collect():
        assert r.score == pytest.approx(plain_ppm(training, ppm.lowered(texts_by_id[r.doc_id]), ppm.ORDER), rel=1e-6)


def test_density(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    from html import unescape

    for page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>?", " " if b.endswith("br>") else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert density.extract(page.html) == "\n".join(b for b in blocks if b), page.page_id


def test_density_layouts():
    page = """<html><body><div id="cookie-notice">We use cookies <a href=x>ok</a></div><div class="menu"><a href=1>Home</a></div>
    <div id=content><h2>A &amp; B</h2>first   para <b>bold</b>,\n same block<div>second<br>line</div><ul><li>one<li>two</ul><p>third<p>fourth
    <table><tr><td>c1<td>c2</table><form>name <input></form></div><div class="comments"><p>nice article, a long comment</p></div>
    <script>if (a < b) document.write("<p>no</p>")</script><footer>foot</footer></body></html>"""
    assert density.extract(page).split("\n") == "A & B|first para bold, same block|second line|one|two|third|fourth|c1|c2".split("|")
    assert density.extract("plain text") == "plain text"
    assert density.extract("<p>cut <b>off</b> in a <a hre") == "cut off in a"
    assert density.extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<div>", "<body>", "", "<img src=x>", "<link rel=x><script>a<b</script><meta name=y><body class=z>"])
def test_density_of_a_head_without_end(start):
    assert density.extract(f"<html><head><title>t</title>{start}text of the page") == "text of the page"
    assert density.extract(f"<html><head><title>t</title></head>{start}text of the page") == "text of the page"


LINES = [f"paragraph {k} " + "of some words " * 12 + "end" for k in range(8)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LINES)


@pytest.mark.parametrize("flags", ["content no-sidebar", "has-sidebar", "page with-footer", "no_sidebar", "sidebar", "main-sidebar"])
@pytest.mark.parametrize("inner", ["%s", "<article>%s</article>", "<main>%s</main>"])
def test_density_keeps_flagged_wrappers(flags, inner):
    page = f'<body><div class="menu">Home news</div><div class="{flags}">{inner % PARAGRAPHS}</div><div class="site-footer">foot</div></body>'
    assert density.extract(page).split("\n") == LINES


def test_density_keeps_slugs():
    half = PARAGRAPHS[: len(PARAGRAPHS) // 8 * 3]
    page = f"""<body><div id=content><div class="post-header"><h2 id="related-work">Related work</h2>{half}</div>
    <h3 id="comments">Comment syntax</h3><section id="search-trees">{half}</section><section id="comment-syntax">{half}</section>
    <div class="comments-area"><p>left out</p></div><div class="nav__list">also out</div></div></body>"""
    text = density.extract(page)
    assert text.count("paragraph 0 ") == 3 and "Related work" in text and "Comment syntax" in text and "out" not in text


def test_density_keeps_bare_text_on_the_way():
    lead = "lead " * 50 + "<b>with</b> an <i>inline</i> part " + "lead " * 30
    plain = " ".join(re.sub("<[^>]*>", "", lead).split())
    section = "".join(f"<p>{'w' * 200}</p>" for _ in range(10))
    for page in ("<div id=c>%s<br><br><div class=s>%s</div></div>", "<div id=c><div class=s>%s</div>%s</div>", "%s<div><div>%s</div></div>"):
        parts = (section, lead) if page.endswith("</div>%s</div>") else (lead, section)
        lines = density.extract("<body>" + page % parts + "<div><a href=1>one</a> | <a href=2>two</a></div>").split("\n")
        assert sorted(lines) == sorted([plain, *["w" * 200] * 10])
    assert "tiny" not in density.extract(f"<body>tiny<div id=c><div>{section}</div></div></body>")


def test_languages(result, docs):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = result("op7_word_backoff")
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_licenses(result, texts_by_id):
    for r in result("op8_license_scan"):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts_by_id[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(","))


def test_license_expressions():
    assert licenses.scan("MIT License, mit-license; Apache\nLicense MIT license license")[1:4] == (4, 0, 6)
    assert licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause")[5:] == ("bsd,gpl,mit", 0.9)
    assert licenses.scan("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */ and more")[5:] == ("gpl", 0.7)
    assert licenses.postfix("A or B and C with D".split()) == "A B C D with and or".split()
    assert licenses.scan("GNU Lesser General Public License")[5] == "gpl,lgpl"


@pytest.mark.parametrize(
    "text, labels",
    [
        ("été SPDX-License-IDENTifier: MIT\nspdx-license-identifier:Apache-2.0", "apache,mit"),
        ("SPDX-License-Identifier: CC-BY-SA-3.0-DE OR MPL-2.0-no-copyleft-exception", "cc-by-sa,mpl"),
        ("SPDX License Identifier: MIT, spdx-license-identifier MIT", ""),
        ("spdx-license-identifier", ""),
        ("a b SPDX-License-Identifier:\nSPDX-License-Identifier: LicenseRef-3rd-party", "licenseref-3rd-party"),
    ],
)
def test_identifier_tags(text, labels):
    assert licenses.scan(text)[5] == labels
    assert licenses.scan("\u1e9eİ x. " * 3 + text + " end")[5] == labels


def test_quality(spark, result):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = result("op9_line_field")
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.9 * len(known)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts, change = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    odds = rng.normal(size=counts.sum())
    good, _ = crf.marginals(odds, change, counts)
    at = 0
    for n in counts:
        weight, share = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(odds[at + k] * y[k] for k in range(n)) + sum(change[y[k], y[k + 1]] for k in range(n - 1)))
            weight += w
            share += w * np.array(y)
        assert np.allclose(good[at : at + n], share / weight)
        at += n


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    width = min(4, len(words))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), seed=42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks):
    root = {i: i for i in marks}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(marks, 2):
        if (marks[a] ^ marks[b]).bit_count() <= 4:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in marks}


def test_simhash(result, texts_by_id):
    marks = {i: plain_simhash(t) for i, t in texts_by_id.items()}
    expected = components(marks)
    rows = result("op10_gray_simhash")
    assert len(rows) == len(marks)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{marks[r.doc_id]:016x}", expected[r.doc_id])


def test_simhash_chains_and_dense_groups(spark):
    rng = np.random.default_rng(3)
    marks, now = {}, int(rng.integers(1 << 62))
    for k in range(60):  # a chain, four bits a step
        marks[k] = now
        for b in rng.choice(64, 4, replace=False):
            now ^= 1 << int(b)
    centre = int(rng.integers(1 << 62))
    for k in range(60, 1500):  # a dense group that is cut into chunks
        marks[k] = centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
    for k in range(1500, 1700):
        marks[k] = int(rng.integers(1 << 62))
    distinct = {m: min(i for i in marks if marks[i] == m) for m in set(marks.values())}
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in distinct]
    edges = simhash.components(simhash.links(spark.createDataFrame(signed, "mark long")))
    root = {r.mark % (1 << 64): r.root % (1 << 64) for r in edges.collect()}
    expected = components({i: m for m, i in distinct.items()})
    groups, wanted = defaultdict(set), defaultdict(set)
    for m, i in distinct.items():
        groups[root.get(m, m)].add(i)
        wanted[expected[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_gray_rank():
    codes = np.array([k ^ k >> 1 for k in range(100)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(100))


def test_language_model_keeps_to_training_rows(spark, docs):
    train = docs.where(~langid.held_out())
    a, b = langid.fit(docs), langid.fit(train)
    assert a["langs"] == b["langs"] and a["entries"].equals(b["entries"])
    assert (a["sizes"] == b["sizes"]).all() and (a["rows"] == b["rows"]).all()
