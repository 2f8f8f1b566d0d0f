"""The corpus operators against brute force, exact round trips and edge cases, on small fixtures."""

import collections
import base64
import gzip
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import bpe, common, components, html_text, langid, line_quality, mixing, nearest, ngram_join, paragraphs, queries, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    """documents from (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] if len(r) > 2 else ("en",)), *(() if len(r) > 3 else ("src0",)), len(r[1]) if r[1] is not None else None) for r in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=0, n=60):
    """Random texts with exact copies, near copies, shared passages, nulls, blanks and a long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 300), 4000) for _ in range(n)]
    passage = prose(rng, 70, 9000)
    for i in range(0, n, 3):
        words = texts[i].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[1].upper(), prose(rng, 20000, 9000), "", " \n\t", None, "one", "one two", "ONE two"]
    for _ in range(6):
        texts.append(prose(rng, rng.randrange(10, 90), 9000) + " " + passage + " " + prose(rng, rng.randrange(10, 90), 9000))
    return list(enumerate(texts))


# ---------------------------------------------------------------- common


def test_word_hashes_tell_words_apart_and_ignore_ascii_case():
    texts = ["Aa bB\tcc\n\xc9t\xe9 ", None, "", "aa  BB cc \xe9t\xe9", "x" * 10000 + " y"]
    for chunk in (10, 1 << 20):
        got = collections.defaultdict(list)
        for first, _, docs, hashes in common.word_hashes(texts, chunk=chunk):
            for d, h in zip(docs, hashes):
                got[first + d].append(h)
        a, b = got[0], got[3]
        assert [len(got[i]) for i in range(5)] == [4, 0, 0, 4, 2]
        assert a[:3] == b[:3] and a[3] != b[3] and len({*a, *b}) == 5


def test_word_hashes_of_a_long_text_do_not_depend_on_pieces():
    rng = random.Random(0)
    text = "\n".join(prose(rng, 50) for _ in range(200)) + " " + "z" * 5000
    (_, _, _, want), = common.word_hashes([text])
    for chunk in (7, 64, 1000):
        (_, n, docs, got), = common.word_hashes([text], chunk=chunk)
        assert n == 1 and not docs.any() and (got == want).all() and len(want) == 10001


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 quality rules


def brute_stats(text):
    words = WORDS.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_base_statistics_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", "a", "a b\na b\n\na b \n", "# $x* é\U0001f600 <&>", "\n".join(["x y z w v u t s r"] * 4)]
    texts += ["\n".join(prose(rng, rng.randrange(30), 3) for _ in range(rng.randrange(12))) for _ in range(60)]
    for t in texts:
        assert line_quality.text_stats(t)[:5] == brute_stats(t), t


def brute_quality(rows, least, share, most, left, min_words, max_repeat):
    """(doc_id, removed words, kept) by plain loops over rows (doc_id, text, lang, host)."""
    norm = lambda line: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split())
    holders, hosts, out = collections.defaultdict(set), collections.defaultdict(set), []
    for _, text, _, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                holders[host, norm(line)].add(text)
    for i, text, _, host in rows:
        lost = sum(len(line.split()) for line in (text or "").split("\n") if norm(line) and len(holders[host, norm(line)]) > max(least, min(share * len(hosts[host]), most)))
        n, _, _, _, repeat = brute_stats(text)
        out.append((str(i), lost, n >= min_words and 100 * repeat <= max_repeat * n and n - lost >= n * left))
    return sorted(out)


@pytest.mark.parametrize(("least", "share", "most"), [(3, 0.1, 1000), (3, 0.9, 12), (1, 0.0, 1)])
def test_line_frequency_matches_brute_force(spark, least, share, most):
    rng = random.Random(2)
    stock = [f"Stock  line {i} of the SITE" for i in range(12)] + ["2024-01-%02d | %d" % (i, i) for i in range(12)]
    rows = []
    for i in range(150):
        lines = [rng.choice(stock[: 1 + rng.randrange(len(stock))]) for _ in range(rng.randrange(5))] + [prose(rng, rng.randrange(2, 20)) for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(rng.sample(lines, len(lines))).upper() if i % 9 == 0 else "\n".join(lines), "en", rng.choice(["a", "a", "b", None])))
    rows += [rows[7]] * 20 + [(500, None, "en", "a"), (501, "", "en", None), (None, rows[3][1], "en", "b"), (502, prose(rng, 50000), "en", "a")]
    options = {"least": least, "share": share, "most": most, "left": 0.5, "min_words": 5, "max_repeat": 60}
    got = line_quality.quality(make(spark, rows).repartition(3), ["doc_id", "text"], **options)
    got = got.withColumn("clean", line_quality.without_lines(F.col("text"), F.col("removed_lines"))).collect()
    assert sorted((str(r.doc_id), r.removed_words, r.kept) for r in got) == brute_quality(rows, **options)
    assert any(r.removed_words for r in got) and any(r.removed_words and not r.kept for r in got) and any(r.removed_words and r.kept for r in got)
    assert all(len((r.text or "").split()) - r.removed_words == len((r.clean or "").split()) for r in got)


def test_lines_that_differ_in_digits_are_different_lines_and_copies_of_a_text_are_one_document(spark):
    rng = random.Random(3)
    rows = [(i, f"row {i} of 90\n{prose(rng, 30, 9000)}", "en", "a") for i in range(40)] + [(100 + i, "a text that many rows repeat in full\n" + "second line of it " * 5, "en", "a") for i in range(40)]
    got = line_quality.quality(make(spark, rows), ["doc_id"], max_repeat=100).collect()
    assert all(r.removed_words == 0 and r.kept for r in got) and len(got) == 80


def test_quality_edge_rows(spark):
    rows = [(1, None), (1, None), (None, "a b c", None, None), (2, ""), (2, "")]
    out = line_quality.quality(make(spark, rows).withColumn("n_words", F.lit("clash")), ["doc_id"])
    assert out.count() == 5 and out.where("kept").count() == 0
    assert line_quality.quality(make(spark, []), ["doc_id"]).count() == 0


# ---------------------------------------------------------------- 2 HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("<script>x</script><!-- c --><style>y</style>", ""),
        ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd\ne"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul><ol start=3><li>p<li>q</ol>", "- x\n- y\n  - z\n\n3. p\n4. q"),
        ("<table><tr><th>A<th>B<tr><td>long<td>1<tr><td>x<td>2</table>", "A     B\nlong  1\nx     2"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r  a\n   b"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("x<div hidden>n</div><span style='display: none'>n</span>y", "xy"),
        ("&lt;b&gt; &amp; é", "<b> & é"),
        ("</p></div>a<b>c", "ac"),
        ("<details><summary>s</summary>hidden</details>", "s"),
        ("<select><option>1<option selected>2</select>", "2"),
        ("<head><title>t</title><p>body", "body"),
        ("<p title=\"a>b\">c</p>", "c"),
        ("<style>.x{display:none} p#y , b{visibility:hidden} i{display:none} @media print{u{display:none}} @media screen{s{display:none}}</style><p class='z x'>n</p><p id=y>n<span style='visibility:visible'>v</span></p><b>n</b><i class=k>n</i><u>u</u><s>n</s>", "v\n\nu"),
        ("<style>div.a{display:none}.b{display:block !important}</style><div class='a b'>x</div><div class=a>n</div><div class=a style='display:block'>y</div><p>.a{}</p>", "x\ny\n\n.a{}"),
        ("<style>ul li{display:none}</style><ul><li>n</ul><ol><li>kept</ol>", "1. kept"),
        ("<style>.a .b{display:none} #c>p{display:none} div > div > i{visibility:hidden}</style><div class=a><u><s class=b>n</s></u></div><div id=c><p>n</p><div><p>y</p><i>n</i></div></div><s class=b>z</s>", "y\n\nz"),
        ("<style>body.m > p, html body #k b{display:none}</style><body class=m><p>n</p><div id=k><p>y<u><b>n</b></u></p></div>", "y"),
        ("<style>div p{display:none} p.s{display:block} a + b, c:hover d, > q{display:none}</style><div><p class=s>n</p><p>n</p></div><a>1</a><b>2</b><q>3</q>", "n\n\n123"),
        ("<textarea>a &amp; b &lt;i></textarea><xmp>c &amp; d</xmp>", "a & b <i>\n\nc &amp; d"),
        ("<div style='visibility:hidden'>n<div style='visibility: visible'>v</div><input value=n><input type=submit></div>", "v"),
        ("a<svg><text>s</text><desc>n</desc></svg><map name=m>t</map><math><mi>x</mi></math>", "astx"),
        ("<input value=v><input type=hidden value=n><input type=submit><input type=reset value=r><input type=password value=n><button>b</button>", "v Submit r b"),
        ("<table><tr>" + "".join(f"<td>c{i}" for i in range(80)) + "<tr>" + "".join(f"<td>{i}" for i in range(80)) + "</table>", "  ".join(f"c{i}" for i in range(80)) + "\n" + "  ".join(str(i).ljust(len(f"c{i}")) for i in range(80)).rstrip()),
        ("<table><tr><td colspan=3>wide</td><td>d</td></tr><tr><td>a</td><td>b</td><td>c</td><td>e</td></tr></table>", "wide     d\na  b  c  e"),
    ],
)
def test_html_rendering(html, text):
    assert html_text.render(html) == text


def test_html_of_long_and_broken_pages_takes_linear_time(spark):
    for html in ("<style>" + "a" * 300_000, "<style>" + "a{" * 100_000, "<style>" + "}" * 300_000, "<div " * 60_000, "<p>" + "x " * 300_000, "<table>" + "<tr><td>x" * 30_000, "&" * 300_000):
        assert isinstance(html_text.render(html), str)
    schema = "page_id long, html string, text string"
    assert html_text.extract_text(spark.createDataFrame([], schema), ["page_id"]).count() == 0


def test_html_of_any_depth_and_brute_force_words(spark):
    deep = "<div>" * 5000 + "x" + "<table><tr><td>" * 500 + "y"
    assert html_text.render(deep).split() == ["x", "y"]
    rng = random.Random(3)
    for _ in range(30):  # visible words in order, whatever the nesting of plain blocks
        words = [f"w{i}" for i in range(20)]
        html = "".join(rng.choice(["<p>", "<div>", "</div>", "<li>", "<b>", "</b> ", "<br>", " "]) + w for w in words)
        assert " ".join(html_text.render(html).replace("- ", "").split()).replace(" ", "") == "".join(words)
    df = html_text.extract_text(spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string"), ["page_id", "text"])
    assert sorted((r.page_id, r.text or "") for r in df.collect()) == [(1, ""), (1, "a")]


@pytest.mark.parametrize(
    ("html", "words"),
    [
        ("<table><tr><form><td>x</td><td>y</td></form></tr></table>", "x y"),
        ("<table><form><tr><td>x</td></tr></form></table>", "x"),
        ("<table><tr>text<td>x</table>", "text x"),
        ("<table><tr><b>bold</b> t<td>x</table>", "bold t x"),
        ("<table><tbody>loose<tr><td>x</tbody><tfoot><i>i</i></table>", "loose i x"),
    ],
)
def test_text_between_cells_and_rows_is_kept(html, words):
    assert html_text.render(html).split() == words.split()


def test_brute_force_words_in_tables():
    rng = random.Random(4)
    for _ in range(300):
        words = [f"w{i}" for i in range(20)]
        tags = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<tbody>", "<thead>", "<form>", "</form>", "<b>", "</b>", "<div>", "<caption>", "<colgroup>", " "]
        html = "".join(f"{rng.choice(tags)}{rng.choice(tags)} {w} " for w in words)
        assert sorted(html_text.render(html).split()) == sorted(words), html


# ---------------------------------------------------------------- 3 mixing


def test_mixing_targets_match_the_loop(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(7)} | {None: 50}
        total, names = 1.5 * sum(sizes.values()), sorted(k for k in sizes if k) + [None]
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        target, capped = {}, set()
        while True:
            free = [n for n in names if n not in capped]
            rest = total - sum(2 * sizes[n] for n in capped)
            target = {n: 2.0 * sizes[n] if n in capped else rest * weight[n] / sum(weight[m] for m in free) for n in names}
            over = {n for n in free if target[n] > 2 * sizes[n]}
            if not over:
                break
            capped |= over
        rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(target)


def test_mix_emits_the_counted_copies_and_repeats_itself(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", f"src{i % 5}" if i % 7 else None) for i in range(400)] + [(900, None), (901, ""), (5, "again"), (None, "no id")]
    docs = make(spark, rows).withColumn("rate", F.lit(1)).repartition(3)
    counted = mixing.mix_counts(docs).collect()
    again = mixing.mix_counts(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.copies) for r in counted) == sorted((str(r.doc_id), str(r.text), r.copies) for r in again)
    assert mixing.mix(docs).count() == sum(r.copies for r in counted) and mixing.mix(docs).columns == docs.columns
    taken, target = collections.Counter(), {}
    for r in counted:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert r.copies <= 2
    assert all(abs(taken[s] - t) < 0.25 * t + 60 for s, t in target.items())
    assert mixing.mix(make(spark, [])).count() == 0


# ---------------------------------------------------------------- 4 n-gram join


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "percent", "long"), [(0, 4, 85, 64), (1, 5, 80, 64), (2, 4, 85, 3)])
def test_ngram_join_is_exact(spark, monkeypatch, seed, k, percent, long):
    """Also with so low a limit of long posting lists that pairs meet by two tokens."""
    monkeypatch.setattr(ngram_join, "LONG", long)
    rng = random.Random(seed)
    rows = [(i * 3 + 1, t) for i, t in corpus(seed)]
    base = prose(rng, 80, 9000).split()
    for i in range(30):  # a group of near copies, some too far from each other
        w = base[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(7, "row that repeats an id " + base[0]), (None, "no id at all here"), (None, " ".join(base))]
    got = ngram_join.cluster(make(spark, rows), k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, k, percent)


def test_ngram_join_without_frequent_room(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    rows = corpus(3, 30)
    got = ngram_join.cluster(make(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 4, 85)
    assert ngram_join.cluster(make(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 WARC

RECORD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def record(n, body):
    return RECORD % (n, len(body), body)


def test_salvage_recovers_later_records_and_logs_every_gap():
    a, b, c = record(1, b"abc"), record(2, b"WARC/1.1\r\nWARC-Type: fake"), record(3, b"")
    broken = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nzz\r\n\r\n"
    member = gzip.compress(a)
    damaged = member[:30] + b"\xff\xff" + member[32:]
    data = a + b"junk" + b + broken + member + damaged + c + gzip.compress(b)[:40]
    got = list(warc.salvage(data))
    assert [f["warc-record-id"] for _, _, f in got if f] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:1>", "<urn:page:3>"]
    assert [x[0] for x in got] == [0, *[x[1] for x in got[:-1]]] and got[-1][1] == len(data)  # nothing unaccounted for
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\nContent-Length: 1\r\n\r\na\r\n\r\n"
    assert [bool(f) for _, _, f in warc.salvage(bad + a)] == [False, True] and list(warc.salvage(b"")) == []
    assert [f["payload"] for _, _, f in warc.salvage(gzip.compress(a + c))] == [b"abc", b""]


def test_warc_digests_of_all_kinds_and_folded_lines():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http;\r\n\tmsgtype=response\r\n%sContent-Length: 22\r\n\r\n" + body + b"\r\n\r\n"

    def fine(*lines, kind=b"response"):
        return [bool(f) for _, _, f in warc.salvage(head % (kind, b"".join(x.encode() + b"\r\n" for x in lines)))] == [True]

    assert fine() and len(body) == 22
    for name in ("sha1", "md5", "sha256", "sha512"):
        good, bad, block = (hashlib.new(name, x).digest() for x in (b"abc", b"abd", body))
        for enc in (bytes.hex, lambda b: b.hex().upper(), lambda b: base64.b32encode(b).decode(), lambda b: base64.b32encode(b).decode().rstrip("=").lower(), lambda b: base64.b64encode(b).decode(), lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")):
            assert fine(f"WARC-Payload-Digest: {name}:{enc(good)}", f"WARC-Block-Digest: {name}:{enc(block)}")
            assert not fine(f"WARC-Payload-Digest: {name}:{enc(bad)}") and not fine(f"WARC-Block-Digest: {name}:{enc(good)}")
            assert fine(f"WARC-Payload-Digest: {name}:{enc(bad)}", kind=b"revisit") and fine(f"WARC-Payload-Digest: {name}:{enc(bad)}", "WARC-Truncated: length")
    assert not fine("WARC-Payload-Digest: sha1:zz") and fine("WARC-Payload-Digest: xxh3:zz")


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/\r\nx", "short"), (2, None, "short"), (3, "u", long), (9, "u", long), (5, "u", long), (None, "u", long), (6, "u", None), (7, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 60), (9, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages.repartition(2), path, archive_bytes=2000)
    back = warc.read_archives(spark, path)
    assert back.where("kind = 'gap'").count() == 0
    got = back.select(warc.page_number("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("r"), "payload").collect()
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        again = h == long and k != 9
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None, b"" if again else b))
    assert sorted(map(str, [(x[0], x[1], x[2], x[3], x[4], bytes(x[5])) for x in got])) == sorted(map(str, want))
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


# ---------------------------------------------------------------- 6 BPE


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["", "a", " ", "  x\n\n y\t", "<|endoftext|>a <|endoftext|>", "it's they'll WE'RE 123 4567", "éè 你好 \U0001f600\U0001f600 \x00\x1c\x1f\x85\xa0 　", "=" * 3000, "ab" * 2000, " " * 500 + "x"]
    texts += ["".join(rng.choice("abcdefgh 'tsre\n.,1éßЖ大") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(chr(c) + " " * (c % 2) for c in range(a, a + 997) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 997)]
    enc = bpe.TrieEncoder(open(path, encoding="utf-8").read())
    for t, ids in zip(texts, enc.encode_batch(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:50]
        assert enc.decode(ids) == lib.decode(want, skip_special_tokens=False) == t
    docs = make(spark, [*enumerate(texts[:12]), (None, None), (1, "a")])
    back = bpe.decode(bpe.encode(docs, path).withColumnRenamed("text", "was"), path)
    assert back.count() == 14 and back.where("coalesce(was, '') != text").count() == 0
    assert bpe.round_trip(make(spark, []), path, ["doc_id"]).count() == 0


def test_bpe_of_cut_characters_decodes_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    lib, enc = tokenizers.Tokenizer.from_file(path), bpe.TrieEncoder(open(path, encoding="utf-8").read())
    ids = lib.encode("\U0001f600你", add_special_tokens=False).ids
    for cut in range(len(ids) + 1):
        assert enc.decode(np.array(ids[:cut], "<u4").tobytes()) == lib.decode(ids[:cut], skip_special_tokens=False)


def test_bpe_rejects_ambiguous_merges():
    spec = {"model": {"vocab": {"a": 0, "aa": 1, "aaa": 2}, "merges": [["a", "a"], ["aa", "a"], ["a", "aa"]]}}
    with pytest.raises(ValueError):
        bpe.TrieEncoder(json.dumps(spec))


# ---------------------------------------------------------------- 7 sharding


def test_sharding_law(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(5, "text 5"), (5, "other"), (None, None), (None, "x")]
    docs = make(spark, rows).withColumn("slot", F.lit("clash"))
    got = sharding.assign_shards(docs.repartition(5), 16).collect()
    shard = {}
    for r in got:
        assert shard.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, 16)
        assert r.size == len((r.text or "").encode()) + 1
    grown = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.03 < grown < 0.09
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    seventeen = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 17).collect()}
    assert all(seventeen[r.doc_id] == r.grown_shard for r in got)
    assert sharding.assign_shards(make(spark, []), 16).count() == 0


def test_weighted_shards_get_their_share(spark):
    got = spark.range(20000).select(sharding.rendezvous(F.col("id"), [0, 1, 2], [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] / 20000 for r in got}
    assert abs(n[2] - 5 / 8) < 0.02 and abs(n[1] - 2 / 8) < 0.02


# ---------------------------------------------------------------- 8 language ID


def test_language_id(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "hijklm"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(30)), lang if i % 10 else None, "s"))
    truth = {}
    rows += [(900, None, "aa", "s"), (901, "123 !?", "bb", "s"), (902, "", "cc", "s"), (None, "abc abc", "aa", "s"), (3, rows[3][1], "aa", "s")]
    got = langid.identify(make(spark, rows), ["doc_id", "text", "lang"]).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.lang and r.text and any(map(str.isalpha, r.text))]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in {*letters, "und"}
        assert (r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text)))
        assert truth.setdefault(r.text, r.lang_pred) == r.lang_pred
    assert {r.lang_pred for r in langid.identify(make(spark, [(1, "abc", None, "s")]), ["doc_id"]).collect()} == {"und"}
    assert langid.identify(make(spark, []), ["doc_id"]).count() == 0


def plain_bucket(gram):
    h = 0
    for k, c in enumerate(gram):
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * int(langid._MULT[k]) & 0xFFFFFFFF)
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 15


def plain_counts(text):
    low = text.lower()
    return collections.Counter(plain_bucket(low[i : i + n]) for n in langid.ORDERS for i in range(len(low) - n + 1))


@pytest.mark.parametrize("chars", [3, 10, langid.CHARS])
def test_counts_and_scores_are_plain_naive_bayes(chars):
    rng = np.random.default_rng(0)
    model = ["x", "y"], np.log([0.3, 0.7]), rng.normal(-5, 1, (langid.BUCKETS, 2))
    texts = ["Ab c", "\xe9", "longer text with words", "\u0130stanbul ab", "abcd" * 9]
    found = [collections.Counter() for _ in texts]
    for text, bucket, n in langid.ngram_counts(texts, chars):
        for t, b, k in zip(text, bucket, n):
            found[t][b] += k
    assert found == [plain_counts(t) for t in texts]
    pred, score = langid.score_texts(texts, model, chars)
    for t, p, s in zip(texts, pred, score):
        total = model[1] + sum(k * model[2][b] for b, k in plain_counts(t).items())
        want = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert p == model[0][total.argmax()] and s == pytest.approx(want.max())


def test_language_ties_go_to_the_first_in_code_point_order():
    model = ["aa", "bb"], np.log([0.5, 0.5]), np.zeros((langid.BUCKETS, 2))
    assert langid.score_texts(["text"], model) == (["aa"], [0.5])


def test_trained_matrix_is_of_plain_counts(spark):
    rows = [(1, "abc", "aa", "s"), (2, "abd abd", "aa", "s"), (3, "xyz", "bb", "s"), (4, None, "bb", "s"), (5, "q", None, "s")]
    langs, prior, matrix = langid.train(make(spark, rows), "lang")
    assert langs == ["aa", "bb"] and np.exp(prior) == pytest.approx([2 / 3, 1 / 3])
    for k, texts in enumerate((["abc", "abd abd"], ["xyz"])):
        want = np.full(langid.BUCKETS, 0.1)
        for t in texts:
            for b, n in plain_counts(t).items():
                want[b] += n
        assert np.exp(matrix[:, k]) == pytest.approx(want / want.sum())


# ---------------------------------------------------------------- 9 paragraph dedup


def test_repeated_passages_are_cut_everywhere_but_once(spark):
    rng = random.Random(9)
    passages = [prose(rng, n, 50000) for n in (51, 52, 80, 200)]
    rows, inside = [], {}
    for i in range(80):
        p = i % 5
        left, right = prose(rng, rng.randrange(0, 120), 50000), prose(rng, rng.randrange(0, 120), 50000)
        rows.append((i, f"{left} {passages[p]} {right}" if p < 4 else f"{left}\n{right}"))
        inside[i] = p
    got = {r.doc_id: r for r in paragraphs.dedup(make(spark, rows)).collect()}
    assert len(got) == 80
    for i, r in got.items():
        p = inside[i]
        if p == 4 or i < 5:
            assert r.spans is None and r.clean_text == r.text and r.removed_words == 0, i
        else:
            n = len(passages[p].split())
            assert n <= r.removed_words <= n + 2 and passages[p] not in r.clean_text, i
            assert {s["owner"] for s in r.spans} == {p}
            kept = r.clean_text.split()
            assert len(kept) == len(r.text.split()) - r.removed_words


def test_exact_and_near_paragraphs(spark):
    rng = random.Random(10)
    text = prose(rng, 300, 50000).split()
    near = text[:]
    for i in range(0, 300, 75):
        near[i] = "changed"
    rows = [(1, " ".join(text)), (2, " ".join(text)), (3, " ".join(near)), (4, None), (5, ""), (None, " ".join(text)), (2, "other text"), (6, " ".join(text[:30]))]
    got = paragraphs.dedup(make(spark, rows).withColumn("spans", F.lit(1))).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 8 and by[1, rows[0][1]].spans is None and by[2, rows[1][1]].removed_words == 300 and by[2, rows[1][1]].clean_text == ""
    assert by[3, rows[2][1]].removed_words > 250 and by[None, rows[5][1]].spans is None and by[6, rows[7][1]].spans is None
    assert paragraphs.dedup(make(spark, [])).count() == 0


def planted(rng, passage):
    return f"{prose(rng, rng.randrange(20, 90), 50000)} {' '.join(passage)} {prose(rng, rng.randrange(20, 90), 50000)}"


def test_passages_with_one_changed_word_are_cut(spark):
    rng = random.Random(11)
    rows, at = [], {}
    for k, n in enumerate([*range(51, 96, 2)] * 4):
        passage = prose(rng, n, 50000).split()
        rows.append((1000 + 2 * k, planted(rng, passage)))
        i = rng.randrange(5, n - 5) if k % 3 else n // 2
        changed = passage[:i] + ["changed"] + passage[i + (k % 2) :]
        rows.append((1001 + 2 * k, planted(rng, changed)))
        at[1001 + 2 * k] = len(changed)
    got = {r.doc_id: r for r in paragraphs.dedup(make(spark, rows)).where("spans is not null").collect()}
    assert set(got) == set(at)
    for i, n in at.items():
        assert n - 5 <= got[i].removed_words <= n + 2 and "changed" not in got[i].clean_text, i


def test_passages_are_cut_whatever_fragments_smaller_documents_hold(spark):
    rng = random.Random(12)
    rows, cut = [], set()
    for k in range(40):
        passage = prose(rng, 60, 50000).split()
        part = (26, 35, 45, 49)[k % 4]
        for j in range(1 + k % 3):
            rows += [(10 * k + 2 * j, planted(rng, passage[:part])), (10 * k + 2 * j + 1, planted(rng, passage[-part:]))]
        rows += [(1000 + 2 * k, planted(rng, passage)), (1001 + 2 * k, planted(rng, passage))]
        rows += [(2000 + 2 * k, planted(rng, passage[:part])), (2001 + 2 * k, planted(rng, passage[-part:]))]
        cut.add(1001 + 2 * k)
    got = {r.doc_id: r for r in paragraphs.dedup(make(spark, rows)).where("spans is not null").collect()}
    assert cut <= set(got) and all(60 <= got[i].removed_words <= 62 for i in cut)
    assert not any(i < 1000 or i in range(1000, 1080, 2) for i in got)


def test_a_frequent_phrase_with_varied_continuations(spark):
    rng = random.Random(13)
    phrase = prose(rng, 30, 50000).split()
    rows, cut = [(i, planted(rng, phrase + prose(rng, 22, 50000).split())) for i in (*range(100), *range(300, 400))], set()
    for k in range(30):
        more = prose(rng, 24, 50000).split()
        rows += [(100 + k, planted(rng, phrase + more)), (200 + k, planted(rng, phrase + more[:12] + ["changed"] + more[13:]))]
        cut.add(200 + k)
    got = {r.doc_id for r in paragraphs.dedup(make(spark, rows)).where("spans is not null").collect()}
    assert got == cut


def words_of(text):
    return WORDS.findall((text or "").lower())


def shingles_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(x, y):
    x, y = shingles_of(x), shingles_of(y)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("seed", [0, 1])
def test_spans_against_brute_force(spark, seed):
    """Complete: of every 50 equal words of two documents the larger id loses its passage (up to its edges). Sound: every linked passage is as similar as it must be."""
    rng = random.Random(20 + seed)
    pool = [prose(rng, rng.randrange(20, 140), 50000).split() for _ in range(12)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(0, max(1, len(p) - 20))
            piece = p[a : a + rng.randrange(20, 120)]
            if rng.random() < 0.4 and len(piece) > 30:
                piece[rng.randrange(len(piece))] = f"e{rng.randrange(10**6)}"
            parts += [*prose(rng, rng.randrange(0, 40), 50000).split(), *piece]
        rows.append((i, " ".join(parts)))
    rows += [(70, prose(rng, 30000, 50000)), (71, None), (72, "")]
    rows.append((73, prose(rng, 30000, 60000) + " " + rows[70][1][-9000:]))
    docs = make(spark, rows).repartition(5)
    words = {i: words_of(t) for i, t in rows}
    links = paragraphs.passage_links(docs).collect()
    assert links
    for r in links:
        assert r.owner < r.doc_id and r.stop - r.start >= 50 and r.owner_stop - r.owner_start >= 50
        assert similarity(words[r.doc_id][r.start : r.stop], words[r.owner][r.owner_start : r.owner_stop]) >= 0.8
    removed = {r.doc_id: {k for s in r.spans for k in range(s["start"], s["stop"])} for r in paragraphs.repeated_spans(docs).collect()}
    first, want, lost = {}, 0, 0
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone = len(removed.get(i, set()).intersection(range(k, k + 50)))
                assert gone >= 10, (i, k)
                want, lost = want + 50, lost + gone
    assert want and lost >= 0.99 * want
    linked = collections.defaultdict(set)
    for r in links:
        linked[r.doc_id].update(range(r.start, r.stop))
    assert removed == linked


def test_recall_of_near_passages(spark):
    """Of passages with several changes whose similarity is 0.8 or more, nearly all are found."""
    rng = random.Random(30)
    rows, near = [], set()
    for k in range(200):
        passage = prose(rng, rng.randrange(55, 260), 50000).split()
        changed = passage[:]
        for _ in range(1 + rng.randrange(1 + len(passage) // 45)):
            at = rng.randrange(1, len(changed) - 1)
            changed[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(1, 3)
        rows += [(2 * k, planted(rng, passage)), (2 * k + 1, planted(rng, changed))]
        if similarity(passage, changed) >= 0.8:
            near.add(2 * k + 1)
    got = {r.doc_id for r in paragraphs.repeated_spans(make(spark, rows)).collect()}
    assert len(near) > 80 and len(near & got) >= 0.98 * len(near) and all(i % 2 for i in got)


def test_clusters_are_components_of_linked_passages(spark):
    rng = random.Random(31)
    a, b = (prose(rng, 70, 50000).split() for _ in range(2))
    rows = [(1, planted(rng, a)), (2, planted(rng, a[:60] + b[:0])), (3, planted(rng, a[8:])), (11, planted(rng, b)), (12, planted(rng, b)), (20, " ".join(a) + " " + prose(rng, 40, 50000) + " " + " ".join(b))]
    got = {r.doc_id: [(s["owner"], s["cluster"]) for s in r.spans] for r in paragraphs.repeated_spans(make(spark, rows)).collect()}
    assert got == {2: [(1, 1)], 3: [(1, 1)], 12: [(11, 11)], 20: [(1, 1), (11, 11)]}


def test_words_between_two_shared_passages_stay(spark):
    rng = random.Random(32)
    a, b = (prose(rng, 60, 50000).split() for _ in range(2))
    rows = [(i, planted(rng, a + prose(rng, 20, 50000).split() + b)) for i in range(20)]
    for r in paragraphs.dedup(make(spark, rows)).where("doc_id > 0").collect():
        kept = r.text.split()
        for s in reversed(r.spans):
            del kept[s["start"] : s["stop"]]
        assert r.clean_text.split() == kept and 120 <= r.removed_words <= 124


@pytest.mark.parametrize(
    ("text", "spans", "left"),
    [("a b c d", [(1, 3)], "a d"), ("a b\nc d", [(1, 3)], "a\nd"), ("a b c", [(0, 3)], ""), ("a b c", [(0, 1)], "b c"), ("a b c ", [(2, 9)], "a b "), ("a\nb\nc", [(1, 2)], "a\nc")],
)
def test_closing_up(text, spans, left):
    assert paragraphs.without_spans(text, [{"start": a, "stop": b} for a, b in spans]) == left


# ---------------------------------------------------------------- 10 nearest neighbours


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.6).astype(np.float32)
    x[100:1100] = x[100]  # a vector with a third of all rows
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(3000)]
    odd = [(3000, None, 0), (3001, [], 0), (3100, [0.0] * 16, 0), (3200, [float("nan")] * 16, 0), (3300, [1.0] * 3, 0), (None, [1.0] * 16, 0), (5, rows[5][1], 0), (3400, [None] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = nearest.nearest(df, lambda i: i % 100 == 0, list_rows=100).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    y, hit, ids = x.astype(np.float64), 0, np.arange(3000)
    assert set(found) == set(range(0, 3000, 100))
    for q, rs in found.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit += len({v for v, _ in rs} & set(best.tolist()))
        assert len(rs) == 10 and q not in [v for v, _ in rs] and rs == sorted(rs, key=lambda r: (r[1], r[0]))
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in rs)
    assert hit / (10 * len(found)) >= 0.9
    assert [v for v, _ in found[100]] == list(range(101, 111))
    assert nearest.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert nearest.nearest(df.where("vec_id in (100, 7)"), lambda i: i % 100 == 0).count() == 1


def brute_nearest(rows, k=10):
    """{query: [(vec_id, score)]} of (id, vector) rows with distinct ids."""
    out = {}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    for i, v in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def found_nearest(spark, rows, **options):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    out = collections.defaultdict(list)
    for r in sorted(nearest.nearest(df, lambda i: i % 100 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_nearest_of_ties_goes_by_id(spark):
    rows = [(i, np.eye(64)[i]) for i in range(64)]  # all as far from each other
    got = found_nearest(spark, rows)
    assert [v for v, _ in got[0]] == list(range(1, 11)) and got == brute_nearest(rows)


def test_nearest_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64) * 5e7
    rows = [(i, base + rng.integers(-2, 3, 64) * 0.25) for i in range(1500)]
    got, want = found_nearest(spark, rows), brute_nearest(rows)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) > 0.9
    huge = [(i, np.full(4, 1e200) * (1 + i)) for i in range(30)]
    found = found_nearest(spark, huge)
    assert [v for v, _ in found[0]] == list(range(1, 11)) and all(np.isfinite(s) for _, s in found[0])


def test_nearest_has_ten_rows_however_small_the_lists(spark):
    rng = np.random.default_rng(4)
    distinct = rng.normal(size=(400, 16))
    rows = [(i, distinct[i] if i < 400 else distinct[7]) for i in range(6000)]  # most rows are copies of one
    got, want = found_nearest(spark, rows, list_rows=4), brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) > 0.9
    few = [(i, [float(i + 1)]) for i in range(7)]
    assert found_nearest(spark, few, list_rows=1) == brute_nearest(few)


def test_recall_on_the_given_table_with_production_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and any(r.embedding)]
    want, got = brute_nearest(rows), collections.defaultdict(set)
    for r in nearest.nearest(df, lambda i: i % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.95


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(1)
    g = nearest.CentroidGraph(rng.normal(size=(600, 8)))
    q = rng.normal(size=(50, 8))
    ids, _ = g.search(q, 32)
    want = np.argsort(nearest.squared(q, g.c), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, want)]) > 0.95


def test_anchors_of_text_that_repeats_itself_are_few():
    same = np.full(1000, 7, dtype=np.uint64)
    assert len(paragraphs.anchors(same, 36)) <= 1 + 1000 // 36
    pairs = np.tile(np.array([5, 9], dtype=np.uint64), 500)
    assert len(paragraphs.anchors(pairs, 36)) <= 1 + 1000 // 36
    mixed = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    at = paragraphs.anchors(mixed, 36)
    assert all(i + int(mixed[i : i + 36].argmin()) in set(at.tolist()) for i in range(1000 - 35))
