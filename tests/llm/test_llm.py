"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import decontaminate, html_text, jaccard_join, kd_shards, lm_scoring, pivot_search, quality, sentencepiece_codec, substring_dedup, text, token_output
from tallyforge.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def corpus(seed=4, n=60):
    """Copies, near copies, shared passages, repeated and odd rows; ``sig`` clashes with names in the operators."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(45)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 6, 9, 30, 60, 120]))]
        if i % 7 == 0 and rows:
            w = list(rng.choice(rows))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
        if i % 9 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        rows.append(w)
    texts = [rng.choice([" ", "\n", "  "]).join(w) for w in rows]
    texts[3] = texts[3].upper()
    texts += [None, "", " \t", "a", "a", "b " * 3000, texts[5], "x\x0by\x0cz", "ein \xa0 wort da"]
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "s") for i, t in enumerate(texts)]
    return out + [out[5], out[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = WORD.findall((t or "").translate(SMALL))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_and_shingles():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    w = text.words(pa.array(texts))
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert [len(s) for s in text.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    h = text.words(pa.array(["a b a b a"])).hashes()
    assert len(set(h.tolist())) == 2 and text.rolling(h, 2)[0] == text.rolling(h, 2)[2] != text.rolling(h, 2)[1]


def brute_groups(rows):
    sets = {}
    for i, t in [(r[0], r[1]) for r in rows]:
        sets.setdefault(i, shingles(t))
    ids, links = sorted(sets), set()
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links.add((a, b))
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sets, links, least


def test_jaccard_join(docs, none):
    sets, links, least = brute_groups(corpus())
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), least[i]) for i in sets}
    found = {(r["a"], r["b"]) for r in jaccard_join.JaccardJoin(docs).links().collect()}
    node = {i: r["class_id"] for i, r in got.items()}
    assert found == {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_boundary():
    assert jaccard_join.boundary(1.0, 80) < jaccard_join.boundary(1000.0, 80)
    for n in range(1, 60):
        for m in range(n, 80):
            c = jaccard_join.need(n, m, 80)
            assert 100 * c >= 80 * (n + m - c) and 100 * (c - 1) < 80 * (n + m - c + 1)


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    rows = []
    for i in range(700):  # over one block of a list
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)[2]


def brute_removed(rows, n=35):
    seen = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r[0]] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring_dedup(docs, none):
    want = brute_removed(corpus())
    got = substring_dedup.digests(docs).collect()
    assert len(got) == len(corpus())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {k: v[:3] for k, v in want.items()}
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in out.collect()} == {k: v[3] for k, v in want.items()}
    assert substring_dedup.digests(none).count() == 0


def test_kd_shards(docs, none):
    rows = kd_shards.shard_documents(docs, 4).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(4)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert kd_shards.shard_documents(none, 4).count() == 0


def test_kd_shards_of_ties_are_even(spark):
    df = spark.createDataFrame([(7, "same text", "en", "s")] * 4000, "doc_id long, text string, lang string, source string")
    counts = [r["count"] for r in kd_shards.shard_documents(df, 16).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 8


def test_pivot_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.4, 12).astype(float).tolist()) for i in range(900)] + [(900, None), (950, [float("nan")] * 12), (951, [float("inf")] * 12), (952, [None] * 12), (953, [0.5] * 3)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    good = {i: np.floor(256 * np.array(v + [0.0] * (12 - len(v)))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in pivot_search.top_k(df).collect()} == want
    assert pivot_search.top_k(df.limit(0)).count() == 0


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_sentencepiece(docs, none):
    model = tokenizer("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec.of(model)
    score = {codec.pieces[i]: v[1] for i, v in ((i, codec.automaton.get(codec.pieces[i])) for i, ok in enumerate(codec.plain) if ok)}
    for t in ["Hello world", "a  b\n\tc", "naïve 日本 \U0001f600x", "the the   the", "x" * 40]:
        s = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 20), j):
                if s[i:j] in score:
                    best[j] = max(best[j], best[i] + score[s[i:j]])
            if s[j - 1] not in codec.singles:
                best[j] = max(best[j], best[j - 1] + codec.unknown)
        ids = codec.encode(t).tolist()
        whole = codec.viterbi(s)
        assert ids == whole and codec.decode(ids) == t
        own, held = 0.0, 0
        for i in ids:
            if i in codec.bytes_of:
                held += (codec.bytes_of[i] & 0xC0) != 0x80
            else:
                own += score[codec.pieces[i]]
        assert own + held * codec.unknown == pytest.approx(best[-1])
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model).collect()
    assert len(out) == len(corpus()) and all(r["decoded"] == (r["text"] or "") for r in out)
    assert sentencepiece_codec.digests(none, model).count() == 0


def test_bit_packing():
    rng = np.random.default_rng(0)
    for width in (1, 7, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
        b = token_output.Block(token_output.block([ids[:3], ids[3:3], ids[3:700], ids[700:]], width))
        assert (b.all() == ids).all() and (b[2] == ids[3:700]).all() and not len(b[1])
    with pytest.raises(ValueError, match="doesn't fit"):
        token_output.block([np.array([4], np.uint32)], 2)


def test_units_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), token_output.Encoder(path)
    rng = random.Random(1)
    signs = ["a", "Bc", "é", "ñ²", "3", "½", " ", "  ", "\n", "\t", "\xa0", " ", "'s", "'ll", "'", ".", "!!", "|", "<|endoftext|>", "日本", "\x1c", "​", "_", "²3"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for t, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_units_are_few_inputs_of_the_library():
    own = token_output.Encoder(tokenizer("byte_bpe_50k.json"))
    library, inputs = own.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            inputs.extend(texts)
            return library.encode_batch_fast(texts, **more)

    own.tokenizer = Counted()
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(3000)})
    texts = [" ".join(words[i : i + 50]) + rng.choice([".", "!\n", "\u3000x", " <|endoftext|>"]) for i in range(0, len(words), 50)]
    for _ in range(2):  # from the library, then from memory
        for t, raw in zip(texts, own.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert len(inputs) < len(words) / 20


@pytest.mark.parametrize("by_units", [True, False])
def test_ids_of_a_batch(by_units):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), token_output.Encoder(path)
    own.by_units &= by_units
    rng = random.Random(2)
    signs = ["a", "É", "ß", "×", "'", "'s", ".", "-", "3", " ", " ", "\n", "\x85", "\xa0", "\u2003", "\u3000", "\u0301", "日" * 70, "<|endoftext|>", "endoftext|"]
    texts = [None, "", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(3000)), None, "x"]
    for kind in (pa.string(), pa.large_string()):
        for last in (None, 2):
            batch = pa.array(["not", *texts, "these"], kind).slice(1, len(texts))
            ids, starts = own.flat(batch, last)
            assert len(starts) == len(texts) + 1
            for t, x, y in zip(texts, starts, starts[1:]):
                assert ids[x:y].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [last] * (last is not None), t
            for few in ([], [None], ["", None]):
                ids, starts = own.flat(pa.array(few, kind), last)
                assert ids.tolist() == [last] * (last is not None) * len(few) and len(starts) == len(few) + 1


def test_token_output(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    where = Scratch(spark, "test").path("blocks")
    token_output.write_blocks(docs, path, where, end_id=2)
    got = sorted(map(tuple, token_output.digests(spark.read.parquet(where)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    start, want = 0, []
    for r in sorted(corpus(), key=lambda r: (r[0], r[1] or "")):
        ids = np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((start, r[0], len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    token_output.write_blocks(none, path, where, end_id=2)
    assert token_output.digests(spark.read.parquet(where)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold
 text</b> here, long enough to matter for the density.<br>Still first.<p>Second&nbsp;one<ul><li>item a<li>item b</ul><script>var a = "</p>";</script><form><input>Search</form><div class="ad">Buy</div></article>
<aside>Side</aside><section id="comments"><p>Nice post, a long comment that says very little about anything.</p></section><footer>Foot</footer></body></html>"""


def test_html(spark):
    want = "Title & more\n\nFirst bold text here, long enough to matter for the density. Still first.\n\nSecond one\n\nitem a\n\nitem b"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("a < b") == "a < b"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "v", "<p>a<p>" + "b " * 50_000, "y")]
    out = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[1]["text"] == want and out[1]["n_chars"] == len(want) and out[2]["text"] == "" and out[3]["n_chars"] == 3 + 2 * 50_000 - 1
    assert html.unescape("&amp;") == "&"


def test_html_of_layout_wrappers(spark):
    """A name or a form around the article doesn't take it away; what is really named so still goes."""
    body = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} has words enough to be the main text of this page, and no link in it.</p>" for i in range(6))
    want = html_text.main_text(f"<body><div>{body}</div></body>")
    assert want.startswith("Head") and want.count("Paragraph") == 6
    extra = '<div class="sidebar"><p>Latest <a href=x>one</a> news</p></div><div class="comments"><div class="comment"><p>Nice, and a rather long comment it is.</p></div></div><form><label>Mail</label><input></form>'
    for tag in ("div", "article"):
        inner = f"<{tag}>{body}</{tag}>"
        for a, b in (('<div class="page has-sidebar">', "</div>"), ('<div id="content" class="no-sidebar">', "</div>"), ('<div class="post comments-open">', "</div>"), ('<div class="side-by-side">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="sidebar layout">', "</div>"), ('<form><div class="social widget">', "</div></form>"), ('<main><form action="/">', "</form></main>"), ('<article class="post comments-open">', "</article>")):
            assert html_text.main_text(f"<html><body>{a}{inner}{b}</body></html>") == want, (tag, a)
            assert html_text.main_text(f"<html><body>{a}{inner}{extra}{b}{extra}</body></html>") == want, (tag, a)
    teasers = '<div class="related">' + "<article><p>Other story, in short words.</p></article>" * 3 + "</div>"
    assert html_text.main_text(f"<body><article>{body}</article>{teasers}</body>") == html_text.main_text(f"<body><div>{body}</div>{teasers}</body>") == want
    assert html_text.main_text(f'<body><div>{body}</div><div class="sidebar">{body.replace("Paragraph", "Side")[:200]}</div></body>') == want


def test_quality(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        bad = i % 4 == 0
        rows.append((i, " | ".join(w) if bad and i % 8 else " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".", "x", "y", 1, "s"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(400, None, "x", "y", 1, "s"), (401, "", "x", "y", 1, "s")]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(1, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.scores(docs, known).collect()}
    assert len(out) == 402 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [i for i, r in out.items() if r["held_out"] and i < 400]
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    kept = quality.accepted(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["predicted"]}
    assert {r["score"] for r in quality.scores(docs, known.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), known).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_periodic_passages_wherever_they_lie():
    """Two equal windows are in one run nowhere in a slice, also where the low bits of places begin anew."""
    rng = random.Random(6)
    lost = 0
    for place in range(1024 - 60, 1024 + 8):
        for n, period in ((36, 1), (40, 1), (45, 2), (50, 5)):
            unit = [f"u{rng.random()}" for _ in range(period)]
            t = " ".join([f"w{rng.random()}" for _ in range(place)] + (unit * n)[:n] + [f"w{rng.random()}" for _ in range(40)])
            w = text.words(pa.array([t], pa.string()))
            h = w.hashes()
            windows = text.rolling(h, 35)
            for first, count in zip(*(c.tolist() for c in (substring_dedup._runs(w, h, 35)[2], substring_dedup._runs(w, h, 35)[4]))):
                lost += len(set(windows[first : first + count].tolist())) < count
    assert lost == 0


def test_periodic_passage_is_removed(spark):
    """One word 36 times in a row, before the place 1024 of a slice and over it."""
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(990 + i)] + [f"x{i}"] * 36 + [f"b{i}_{j}" for j in range(1022 - i)])) for i in range(0, 36)]
    out = substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {i: 36 for i, _ in rows}


def test_decontamination(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(5)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for i in range(12)] + [(90, None), (91, "too short")]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 2:
            item = items[i % 12][1].split()
            for _ in range(i // 12):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            at = rng.randint(0, len(w))
            w[at:at] = item
        rows.append((i, (" ".join(w)).upper() if i % 5 == 0 else ", ".join(w)))
    rows += [(80, None), (81, ""), (82, items[0][1]), (83, " ".join(items[1][1].split()[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        for k, s in items[:12]:
            item = s.split()
            n, most = len(item), int(0.15 * len(item))
            if any(edit(w[at : at + n], item) <= most for at in range(max(1, len(w) - n + 1))):
                want.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and len(want) > 20
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0


def test_decontamination_with_free_ends(spark):
    """Against brute force over stretches of any length: copies inside longer text with words dropped, added or replaced."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(900)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((7, 14, 20, 40, 59, 120))]
    rows = []
    for i in range(90):
        k = i % 6
        item = items[k][1].split()
        for _ in range(max(0, int(0.15 * len(item)) - i // 60 + (i % 7 == 0))):
            at = rng.randrange(len(item))
            item[at : at + (i // 6 % 3 > 0)] = [rng.choice(words)] * (i // 6 % 3 != 1)
        rows.append((i, " ".join([rng.choice(words) for _ in range(30)] + item + [rng.choice(words) for _ in range(30)])))
    rows += [(90, " ".join([items[2][1]] * 3)), (91, "x " * 500), (92, " ".join(items[3][1].split()[6:])), (93, " ".join(items[3][1].split()[7:]))]
    rows += [(94, " ".join(items[3][1].split()[:-1] + items[3][1].split() + items[3][1].split()[1:]))]
    want = {}
    for i, t in rows:
        w = t.split()
        for k, s in items:
            row, item = [0] * (len(w) + 1), s.split()
            for a, x in enumerate(item, 1):
                new = [a]
                for j, y in enumerate(w, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= int(0.15 * len(item)):
                want[i, k] = min(row)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench, free_ends=True).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and (92, 3) in want and (93, 3) not in want and len(want) > 70
    assert sorted((r["start_word"], r["n_words"], r["edits"]) for r in got if r["doc_id"] == 90) == [(0, 20, 0), (20, 20, 0), (40, 20, 0)]
    assert sorted((r["start_word"], r["n_words"], r["edits"]) for r in got if r["doc_id"] == 94) == [(0, 39, 1), (39, 40, 0), (79, 39, 1)]
    texts, bodies = dict(rows), dict(items)
    for r in got:
        found = texts[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["n_words"]]
        assert edit(found, bodies[r["item_id"]].split()) == r["edits"] <= int(0.15 * len(bodies[r["item_id"]].split()))
    assert all(min(r["edits"] for r in got if (r["doc_id"], r["item_id"]) == p) == d for p, d in want.items())
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, bench, free_ends=True).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_decontamination_of_a_few_long_items():
    """Long items among many short ones: each copy with as many edits as are allowed is found."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(7)) for _ in range(3000)]
    items = [[rng.choice(words) for _ in range(n)] for n in [20] * 150 + [400, 1000]]
    index = decontaminate.Index.of(list(range(152)), [" ".join(x) for x in items], edits=0.15, min_words=5, free_ends=True)
    texts = []
    for i in range(60):
        item = list(items[150 + i % 2])
        for at in rng.sample(range(len(item)), int(0.15 * len(item))):
            item[at] = "q" + item[at]
        texts.append(" ".join(["y"] * 5 + item + ["z"] * 5))
    w, h = decontaminate.symbols(pa.array(texts, pa.string()))
    assert {(row, k) for row, k, *_ in index.matches(w.first, h)} == {(i, 150 + i % 2) for i in range(60)}


def test_lm_scores(docs, none):
    rows = corpus()
    words = [(r[0], WORD.findall((r[1] or "").translate(SMALL))) for r in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def s(h, w):
        if not h:
            return counts[(w,)] / total
        return counts[(*h, w)] / counts[h] if counts[(*h, w)] >= 2 else 0.4 * s(h[1:], w)

    want = {i: (len(w), sum(math.log(s(tuple(w[max(0, j - 2) : j]), w[j])) for j in range(len(w)))) for i, w in words}
    got = lm_scoring.scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_words"] == want[r["doc_id"]][0] and r["log_score"] == pytest.approx(want[r["doc_id"]][1])
    assert lm_scoring.scores(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    passage, item = prose(60), prose(30)
    for i in range(200):
        t = prose(rng.randint(60, 120))
        bad = i % 5 == 0
        if bad:
            t = t.upper().replace(" ", "!! ")
        elif i % 40 == 1:
            t += "\n" + passage
        elif i == 7:
            t += " " + item
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 0 if bad else 1, 0))
    rows.append((500, rows[3][1] + " tail", "en", "s", 1))
    rows.append((501, rows[3][1], "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = sentencepiece_codec.Codec.of(tokenizer("piece_bpe_32k.model"))
    back = {r["doc_id"]: codec.decode(r["piece_ids"]) for r in out}
    assert set(back) == {i for i in range(200) if i % 5} - {7} and all(r["same"] for r in out)
    assert passage not in back[41] and back[41].strip() == rows[41][1].split("\n")[0] and back[2] == rows[2][1]


def test_jaccard_equal_and_null_ids(spark):
    """Rows are documents by their text: equal ids don't join sets, null ids have components too."""
    base = [f"w{i}" for i in range(40)]
    near, other = " ".join(base[:39] + ["z"]), " ".join(f"v{i}" for i in range(30))
    rows = [(5, " ".join(base)), (5, other), (3, other), (7, near), (None, " ".join(base)), (None, "alone here"), (5, other), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(5, 36, 5), (5, 26, 3), (3, 26, 3), (7, 36, 5), (None, 36, 5), (None, 1, None), (5, 26, 3), (8, 0, 8), (8, 0, 8)]))
    kept = [tuple(r) for r in jaccard_join.deduplicated(df).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, " ".join(base)), (3, other), (None, "alone here"), (8, None)]))


def brute_windows(runs, windows, n):
    """For each window's start: the longest match elsewhere in its group, by words."""
    out = []
    for i, (g, a) in enumerate(runs):
        for x in range(windows[i]):
            best = 0
            for j, (f, b) in enumerate(runs):
                for y in range(windows[j]):
                    if f == g and (i, x) != (j, y):
                        k = 0
                        while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                            k += 1
                        best = max(best, k)
            out.append(best)
    return out


def test_lempel_ziv_factors():
    rng = random.Random(12)
    for trial in range(30):
        n = rng.choice([3, 6])
        base = [rng.choice("abc") * rng.randint(1, 2) for _ in range(20)]
        runs = []
        for _ in range(rng.randint(1, 9)):
            a = rng.randrange(10)
            w = base[a : a + n + rng.randint(0, 8)]
            w += ["z"] * (n - len(w))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "y"
            runs.append((rng.randrange(2), w))
        windows = np.array([len(w) - n + 1 for _, w in runs])
        index = substring_dedup.Reference.of(np.array([g for g, _ in runs]), pa.array([" \t".join(w) for _, w in runs], pa.large_string()), windows, n)
        want = brute_windows(runs, windows.tolist(), n)
        assert index.longest.tolist() == want
        row, first, size = (x.tolist() for x in substring_dedup.parse(index.longest, windows, n))
        begin = np.cumsum(windows) - windows
        for i, r in enumerate(row):  # each factor is the longest there, and the next one begins where it ends
            assert size[i] == max(1, want[begin[r] + first[i]])
            if i + 1 < len(row) and row[i + 1] == r:
                assert first[i + 1] == first[i] + size[i]
            else:
                assert first[i] + size[i] >= windows[r]
        assert substring_dedup.matched(index.longest, windows, n).tolist() == [x >= n for x in want]


@pytest.mark.parametrize(("hot", "rows"), [(0, 4096), (2, 3)])
def test_substring_dedup_of_hot_anchors(spark, docs, monkeypatch, hot, rows):
    """Whether by blocks or by windows: the same words go; and with keep_first each passage stays once."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", rows)
    want = brute_removed(corpus())
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(docs).collect()} == {k: v[1] for k, v in want.items()}
    out = sorted((r["doc_id"], r["text"]) for r in substring_dedup.dedup(docs, keep_first=True).collect() if r["text"])
    all_words = {i: WORD.findall(t or "") for i, t, *_ in corpus()}
    first = {}
    for i in sorted(all_words):
        for j in range(len(all_words[i]) - 34):
            first.setdefault(tuple(all_words[i][j : j + 35]), (i, j))
    kept = {}
    for i, w in all_words.items():
        gone = {j + k for j in range(len(w) - 34) if first[tuple(w[j : j + 35])] != (i, j) for k in range(35)}
        kept[i] = [x for j, x in enumerate(w) if j not in gone]
    same = {r[0] for r in corpus() if [x[1] for x in corpus()].count(r[1]) > 1 and r[1]}
    assert {i: WORD.findall(t) for i, t in out if WORD.findall(t) and i not in same} == {i: w for i, w in kept.items() if w and i not in same}


def test_decontamination_recall(spark):
    """Copies with as many edits as are allowed, inside other text: at least nine in ten of each size."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    sizes = [7, 9, 13, 18, 25, 40, 64, 65, 150, 400]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate(sizes)]
    rows, want = [], []
    for i in range(300):
        k = i % len(sizes)
        item = items[k][1].split()
        for _ in range(int(0.15 * len(item))):
            at, kind = rng.randrange(len(item)), rng.randrange(3)
            item[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(words)]
        rows.append((i, " ".join([rng.choice(words) for _ in range(40)] + item + [rng.choice(words) for _ in range(40)])))
        want.append((i, k))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(50)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=True).collect()}
    assert not {x for x in got if x[0] >= 1000}
    for k in range(len(sizes)):
        own = [x for x in want if x[1] == k]
        assert sum(x in got for x in own) >= 0.9 * len(own), sizes[k]


def test_decontamination_odd_items(spark):
    """Short items word for word, repetitive and long ones in bounded time, repeated rows, clashing names."""
    import time

    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    items = [(1, "two words"), (2, "One"), (3, "x " * 100), (4, long), (4, long), (5, None), (6, " .,; ")]
    rows = [(1, "has two, words here", "a"), (2, "two other words", "a"), (3, "x " * 8000, "a"), (4, "start " + long.replace("w1", "v1") + " end", "a"), (5, None, None), (6, "", "a"), (7, "the one", "b"), (7, "the one", "b")]
    began = time.time()
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=True, edits=0.15).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 3), (4, 4), (7, 2)} and sum(r["doc_id"] == 7 for r in got) == 2
    assert time.time() - began < 120
    with pytest.raises(ValueError, match="repeats find"):
        decontaminate.Index.of([1], [" ".join(f"a{i}" for i in range(60))], 0.9, 1, True, 0.999)


def test_lm_tables(spark):
    """Tables by hash agree with Spark's own hash, and repeated and equal ids are documents of their own."""
    from pyspark.sql import functions as F

    a, b = np.array([5, 2**63 + 9], np.uint64), np.array([7, 1], np.uint64)
    rows = [(int(x.view(np.int64)), int(y.view(np.int64))) for x, y in zip(a, b)]
    assert [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()] == lm_scoring.joined(a, b).view(np.int64).tolist()
    rows = [(1, "a b a b"), (1, "a b a b"), (1, "c c"), (None, "a b"), (None, None), (2, ""), (3, "b " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sent, bucket in ((0, 10**6), (1, 3)):
        model = lm_scoring.LanguageModel(df, sent=sent, bucket=bucket)
        counts = Counter(tuple(w[i : i + n]) for w in ((t or "").split() for _, t in rows) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        got = model.scores(keep=True).collect()
        for n in (1, 2, 3):
            assert sorted(r["n"] for r in model.table(n).collect()) == sorted(v for k, v in counts.items() if len(k) == n and (n == 1 or v > 1))
        assert len(got) == len(rows) and len({r["log_score"] for r in got if r["doc_id"] == 1}) == 2
        total = sum(v for k, v in counts.items() if len(k) == 1)
        own = next(r for r in got if r["doc_id"] is None and r["n_words"])
        assert own["log_score"] == pytest.approx(math.log(counts["a",] / total) + math.log(counts["a", "b"] / counts["a",]))


def test_lm_tables_lie_by_hash(spark):
    """The table of every length lies in as many parts as the corpus asks for, each n-gram in that of its hash; scores are those of one part."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 120)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t.split()) for _, t in rows)
    model = lm_scoring.LanguageModel(df, sent=5, bucket=total // 7)
    got = {r["doc_id"]: r["log_score"] for r in model.scores(keep=True).collect()}
    counts = Counter(tuple(w[i : i + n]) for w in (t.split() for _, t in rows) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for n in (1, 2, 3):
        table = model.table(n).select("gram", "n", "part", F.input_file_name().alias("file")).collect()
        assert sorted(r["n"] for r in table) == sorted(v for k, v in counts.items() if len(k) == n and (n == 1 or v > 1))
        assert len({r["gram"] for r in table}) == len(table)
        parts = lm_scoring.bucket_of(np.array([r["gram"] for r in table], np.int64).view(np.uint64), model.buckets)
        assert [r["part"] for r in table] == parts.tolist() and len(set(parts.tolist())) > 3
        assert all(f"/part={r['part']}/" in r["file"] for r in table)
        assert len({r["file"] for r in table}) <= lm_scoring.passes_of(n) * model.buckets
    whole = lm_scoring.LanguageModel(df)
    assert whole.buckets == 1 and got == pytest.approx({r["doc_id"]: r["log_score"] for r in whole.scores().collect()})


def test_lm_orders_of_equal_keys():
    """Equal rows stand together, as they came, also where keys agree in all the bits that the sort looks at."""
    rng = np.random.default_rng(5)
    for bits, n in ((0, 0), (0, 1), (3, 50), (12, 3000), (64, 3000)):
        key = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(64 - bits) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = rng.integers(0, 3, n).astype(np.uint64)
        order = lm_scoring.together(key, [key, other])
        rows = list(zip(key[order].tolist(), other[order].tolist(), order.tolist()))
        assert sorted(order.tolist()) == list(range(n))
        assert len(lm_scoring._starts([key[order], other[order]])) == len({r[:2] for r in rows})
        assert all(a[2] < b[2] for a, b in zip(rows, rows[1:]) if a[:2] == b[:2])


def test_lm_rows_of_arrays():
    """What a row of exploded n-grams holds is read back, whether it has fewer or more n-grams than there are documents."""
    rng = np.random.default_rng(6)
    for n, docs in ((5000, 40), (300, 7000), (1, 1), (0, 3)):
        gram = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        row, number, key = rng.integers(0, docs, n).astype(np.int32), rng.integers(1, 70000, n), rng.integers(0, 1 << 62, docs)
        got = []
        for r in lm_scoring._of_documents(lm_scoring.bucket_of(gram, 3), gram, row, number, key).to_struct_array():
            own = lm_scoring._whole(r["gram"])
            keys = np.frombuffer(r["keys"].as_buffer(), np.int64)[lm_scoring._wide(r["row"], len(own))]
            assert len(r["keys"].as_py()) <= 8 * max(docs if docs < len(own) else 0, len(set(keys.tolist())))
            got += zip(own.tolist(), keys.tolist(), lm_scoring._wide(r["k"], len(own)).tolist())
        assert got == list(zip(gram.tolist(), key[row].tolist(), number.tolist()))


def test_lm_tables_are_made_of_arrays(spark, monkeypatch):
    """Longer n-grams meet the tables of shorter ones as arrays of a bucket, not as a row each; tables are right whether prefixes and suffixes are sent or asked for."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(200))) for i in range(30)]
    counts = Counter(tuple(w[i : i + n]) for w in (t.split() for _, t in rows) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    saved, save = [], lm_scoring.Scratch.save

    def counted(self, df, name, *a, **b):
        out = save(self, df, name, *a, **b)
        if name == "counts":
            saved.append(out.count())
        return out

    monkeypatch.setattr(lm_scoring.Scratch, "save", counted)
    for sent, bucket in ((0, 10**6), (6, 3000), (10**5, 10**6)):
        model = lm_scoring.LanguageModel(spark.createDataFrame(rows, "doc_id long, text string"), sent=sent, bucket=bucket)
        saved.clear()
        model.scores(keep=True).count()
        assert len(saved) == 3 and max(saved) <= model.buckets * (1 + 2 * model.buckets)
        for n in (2, 3):
            want = sorted((v, math.log(v / counts[k[:-1]])) for k, v in counts.items() if len(k) == n and v > 1)
            got = sorted((r["n"], r["score"]) for r in model.table(n).collect())
            assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])


def test_pipeline_stages_by_brute_force(spark, none):
    """Repeated rows, null ids and texts, empty texts: each stage by itself against plain Python, and over an empty table."""
    import corpus_pipeline

    near, cut = corpus_pipeline.near_copies, corpus_pipeline.repeated_passages
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, long[0]), (1, long[0]), (2, long[1]), (3, long[1]), (9, long[2]), (None, long[2] + " end"), (None, None), (5, None), (6, ""), (6, ""), (7, " \t"), (8, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = near(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect())))
    assert got == sorted(map(str, [(1, long[0]), (2, long[1]), (None, long[2] + " end"), (None, None), (5, None), (6, ""), (7, " \t"), (8, "few words")]))
    # What stays after the first stage has no repeats any more, so nothing is cut.
    after = sorted(map(str, ((r["doc_id"], r["text"], r["n_chars"]) for r in cut(spark, kept, "").collect())))
    assert after == sorted(map(str, ((i, t, None if t is None else len(t)) for i, t in ((r["doc_id"], r["text"]) for r in kept.collect()))))
    # Every other corpus: the words that the contract of op6 keeps.
    rows = [r for r in corpus() if r[0] not in (5, 66)]
    want = {i: v[3] for i, v in brute_removed(rows).items()}
    out = {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in cut(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    gone = {r[0] for r in rows if WORD.search(r[1] or "") and not want[r[0]]}
    assert out == {i: t for i, t in want.items() if i not in gone}
    empty = none.select(*corpus_pipeline.COLUMNS)
    assert near(spark, empty, "").count() == 0 and cut(spark, empty, "").count() == 0 and corpus_pipeline.encoding(spark, empty, "").count() == 0


def test_quality_by_brute_force(spark):
    """The score from its definition: class means and shrunk covariances, log densities by inverse and determinant."""
    rng = np.random.default_rng(4)
    n, d = 300, len(quality.NAMES)
    x = rng.normal(0, 1, (n, d)) + np.outer(np.arange(n) % 3 == 0, np.linspace(0, 1.5, d))
    y = (np.arange(n) % 3 != 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = quality.fit(df, labels).score(x)
    z = (x - x.mean(0)) / x.std(0)
    cov = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((y == k).sum() * cov[k] for k in cov) / n
    log = {}
    for k in (0, 1):
        s = (1 - quality.SHRINK_POOLED) * cov[k] + quality.SHRINK_POOLED * pooled
        s = (1 - quality.SHRINK_UNIT) * s + quality.SHRINK_UNIT * np.trace(s) / d * np.eye(d)
        off = z - z[y == k].mean(0)
        log[k] = np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off)
    assert np.allclose(got, 1 / (1 + np.exp(-(log[1] - log[0]) / quality.TEMPERATURE)))


def test_quality_statistics_by_hand():
    """Word counts, repeats and kinds of letters of odd texts, one at a time and together."""
    texts = ["", "a", "A b! C? 12 12 | |", "é é\tü", "x " * 500, None, "Hello, world.\nHello again."]
    every = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], every[i])
        words = WORD.findall(t or "")
        assert every[i][0] == pytest.approx(math.log1p(len(words)))
        assert every[i][1] == pytest.approx(math.log1p(len((t or "").encode()) / max(1, len(words))))
        assert every[i][2] == pytest.approx(math.log1p(len(set(words))) / math.log1p(max(1, len(words))))


def test_kd_shards_by_brute_force(spark):
    """Splits at weighted medians along the widest dimension, one node after the other in plain Python."""
    rng = random.Random(17)
    rows = [(i, "x" * rng.choice([0, 3, 40, 900]), rng.choice("pq"), rng.choice("uvw")) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards.shard_documents(df, 8).collect()
    size = {i: len(t) + 1 for i, t, *_ in rows}
    point = {i: (i, len(t), zlib.crc32(s.encode()), zlib.crc32(g.encode())) for i, t, g, s in rows}
    whole = [max(p[k] for p in point.values()) - min(p[k] for p in point.values()) for k in range(4)]
    shard = {r["doc_id"]: r["shard"] for r in got}
    for bits in (3, 2, 1):  # from the root down: the two sides of each node
        sides = {}
        for i, s in shard.items():
            sides.setdefault(s >> bits, ([], []))[s >> (bits - 1) & 1].append(i)
        for left, right in sides.values():
            own = left + right
            spread = [(max(point[i][k] for i in own) - min(point[i][k] for i in own)) / max(1, whole[k]) for k in range(4)]
            k = max(range(4), key=lambda k: (spread[k], -k))
            assert max(point[i][k] for i in left) <= min(point[i][k] for i in right)
            a, b = sum(size[i] for i in left), sum(size[i] for i in right)
            assert abs(a - b) <= 2 * max(size[i] for i in own) + 4e-4 * (a + b)


def test_sentencepiece_of_random_texts():
    """The best score of a plain Viterbi over all pieces, for random texts of many scripts."""
    codec = sentencepiece_codec.Codec.of(tokenizer("piece_bpe_32k.model"))
    score = {codec.pieces[i]: codec.automaton.get(codec.pieces[i])[1] for i, ok in enumerate(codec.plain) if ok}
    longest = max(map(len, score))
    rng = random.Random(23)
    signs = ["a", "the", " ", "ing", "é", "ß", "日", "本", "\U0001f600", "\n", "\t", "0", "42", ".", "▁", "и", "ка", "  ", "\x00", "़"]
    for _ in range(300):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        ids = codec.encode(t).tolist()
        assert codec.decode(ids) == t.replace("▁", " ")
        if not t:
            continue
        s = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - longest), j):
                if s[i:j] in score:
                    best[j] = max(best[j], best[i] + score[s[i:j]])
            if s[j - 1] not in codec.singles:
                best[j] = max(best[j], best[j - 1] + codec.unknown)
        own, held = 0.0, 0
        for i in ids:
            if i in codec.bytes_of:
                held += (codec.bytes_of[i] & 0xC0) != 0x80
            else:
                own += score[codec.pieces[i]]
        assert own + held * codec.unknown == pytest.approx(best[-1])


def plain_density_choice(tree):
    """The density rule straight from its formula, each subtree counted anew."""
    n = len(tree.tag)
    inside = lambda i: range(i, tree.end[i])
    up = lambda i: [i, *up(tree.parent[i])] if i > 0 else [0]
    linked = [any(tree.tag[j] == "a" for j in up(i)) for i in range(n)]
    size = [0] * n
    for node, s in tree.pieces:
        if s and not tree.gone[node]:
            size[node] += len("".join(s.split()))
    c = [sum(size[j] for j in inside(i)) for i in range(n)]
    lc = [sum(size[j] for j in inside(i) if linked[j]) for i in range(n)]
    t = [sum(not tree.gone[j] for j in inside(i) if j != i) for i in range(n)]
    lt = [sum(not tree.gone[j] and tree.tag[j] == "a" for j in inside(i) if j != i) for i in range(n)]
    body = next((i for i in range(n) if tree.tag[i] == "body" and c[i] == c[0]), 0)
    density = [0.0] * n
    for i in range(n):
        if c[i] and not tree.gone[i]:
            base = math.log(c[i] / max(1, c[i] - lc[i]) * lc[i] + lc[body] / max(1, c[body]) * c[i] + math.e)
            ratio = c[i] / max(1, lc[i]) * max(1, t[i]) / max(1, lt[i])
            density[i] = c[i] / max(1, t[i]) * math.log(max(ratio, 1e-9)) / max(math.log(base), 0.05)
    total = [sum(density[j] for j in range(n) if j and tree.parent[j] == i) for i in range(n)]
    return body, density, total


def test_html_density_by_brute_force():
    """Densities and sums from the formula, and the best subtree, on pages of many shapes."""
    rng = random.Random(3)
    words = ["word", "other", "long-winded", "x"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))

    def node(depth):
        tag = rng.choice(["div", "p", "section", "span", "ul", "a", "article", "li", "table"])
        inner = "".join(node(depth - 1) if depth and rng.random() < 0.6 else text() for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(120):
        tree = html_text.Tree("<html><body>" + "".join(node(3) for _ in range(rng.randint(1, 4))) + "</body></html>")
        body, density, total = plain_density_choice(tree)
        got = tree.densities()
        assert got[2] == body and np.allclose(got[0], density) and np.allclose(got[1], total)
        best = max(range(body, tree.end[body] if body else len(tree.tag)), key=lambda i: (round(total[i], 9), -i))
        assert total[best] <= 0 or any(a <= best < b or best <= a < tree.end[best] for a, b in tree.chosen())


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_html_of_the_tables():
    """Every page of the table against a reader that only knows these pages' parts."""
    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        own = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        own = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", own, flags=re.S)
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))) for b in re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", own))
        want = "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())
        assert html_text.main_text(row["html"]) == want, row["page_id"]
    assert html_text.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> so to say.</p></article>") == "Energy is E=m so to say."
