"""PII, WARC, URL filter, fingerprints, mixing: brute force and defined results for odd tables."""

import math
from collections import Counter

import base64
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import fingerprint, mixing, pii, url_filter, warc
from tickloom.llm.queries import URL_RULES
from tickloom.session import scratch_path

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+", "phone": "\\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c@d.e.f x@y a@b..c a@b.c.", "_a%+-@x-y.co.uk,b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.00.1 1.2.3", "é😀 a@b.cd 1.1.1.1", "4111 1111-1111 1111", "41111111111111112",
    "4785380592391139$$$", "+1 (262) 555-3752 +1234 +12345678(", "+1+2 3456789012", "9" * 3000 + ".", "a" * 3000 + " @", "a@b" + ".c" * 6000, "+1" + "(" * 4000, "", None,
]


def test_base_spans(spark, odd, odd_rows):
    texts = TRICKY + [r[1] for r in odd_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).withColumn("s", pii.as_text(F.col("base"))).collect()}
    for i, t in enumerate(texts):
        assert got[i].s == plain_spans(t), t and t[:60]
        assert got[i].n_email == plain_spans(t).count("email:")
    assert pii.find(odd).count() == len(odd_rows)
    assert pii.find(odd.where("doc_id < -5")).count() == 0


def test_base_spans_random(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aa11.@-+ (é") for _ in range(rng.randrange(40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", pii.as_text(F.concat(*[pii.base_spans(F.col("text"), k) for k in pii.KINDS])).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_disclosing_words_are_added_and_replaced(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = " ".join(f"w{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(30))
        if i % 10 == 0:
            text += " Contactme at someone@mail.example and contactme again"
        rows.append((i, text))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        if r.doc_id % 10:
            assert not r.added and r.redacted is None
        else:
            text = rows[r.doc_id][1]
            words = [text[s.start : s.end].lower() for s in r.added]
            assert words.count("contactme") == 2 and "someone" not in words
            assert "@" not in r.redacted and "[email]" in r.redacted and "ontactme" not in r.redacted


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    mark = "x\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "u", "same", "c"), (3, "u", "same", "c"), (9, None, None, "c"), (8, "u", "", "c"), (10, "u", mark, None), (11, "u", "é😀" * 5000, "c"), (12, "u", mark * 3000, "c"), (13, "u", "\r\n\r\n", "c"), (3, "u", "same", "c"), (None, "u", "lone", "c")]
    path = scratch_path(spark, "warc")
    warc.write(pages(spark, rows), path, chunk=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()), key=str)
    least = {}
    for i, _, html, _ in rows:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        again = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    chunks = warc.read_chunks(spark, path).where("page_id = 12").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.chunk) for c in chunks) == (mark * 3000).encode() and max(len(c.chunk) for c in chunks) <= 1000
    assert [c.chunk_no for c in chunks] == list(range(1, len(chunks) + 1))


def test_warc_empty_and_damaged(spark, tmp_path):
    path = scratch_path(spark, "warc")
    warc.write(pages(spark, [(1, "u", "x" * 50, "")]).where("page_id = 2"), path)
    assert warc.read_records(spark, path).count() == 0
    (tmp_path / "a.txt").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 1\r\nWARC-Payload-Digest: sha1:X\r\nX-Payload-Bytes: 3\r\nX-Digest-So-Far: X\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="does not fit"):
        warc.read_records(spark, str(tmp_path)).collect()


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path, host = re.match("[^?#]*", rest[len(host) :]).group(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(t), t, v) for v, t in URL_RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_method(spark):
    urls = [
        None, "", "nothing", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://org", "http://org/", "http://borg/", "x://com/fr/#a", "x://q.com/de/a/b/c/d/e/f/g/h",
        "http://É.com/de/é", "http://a.net/?://b", "http://a.com?/de/", "://com/de/", "http://h.com//de/",
    ] + [f"http://h.com/de/{i}" for i in range(80)] + [f"http://h.com/fr/{i}.html" for i in range(80)] + [f"http://n.net/x/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, "a") for i, u in enumerate(urls)] + [(0, None, "b")], "page_id long, url string, host string")
    got = url_filter.judge(df, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        if rule is None:
            assert (r.verdict == "block") == (r.purity >= url_filter.REJECT)
    templates = {r.template for r in got if r.host == "h.com"}
    assert "de/*" in templates and len(templates) < 10
    assert url_filter.judge(df.where("page_id < 0"), URL_RULES).count() == 0


def test_method_blocks_what_looks_like_blocked(spark):
    rows = [(i, f"http://h.com/bad/{i}") for i in range(300)] + [(1000 + i, f"http://h.com/good/{i}") for i in range(300)]
    rules = [("block", f"h.com/bad/{d}") for d in "123456"] + [("allow", f"h.com/good/{d}") for d in "123456"]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert got and all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in got)


def test_verdicts_do_not_depend_on_the_number_of_siblings(spark):
    """Small sections, and then larger ones that leave each labelled section under RARE, change no verdict."""
    rules = [("block", f"h.com/bad/{d}") for d in "123456"] + [("allow", f"h.com/good/{d}") for d in "123456"]
    own = [f"http://h.com/{section}/{i}" for section in ("bad", "good") for i in range(300)]
    for sections, each in ((64, 5), (65, 5), (1000, 5), (1000, 40)):
        urls = own + [f"http://h.com/s{k}/{i}" for k in range(sections - 2) for i in range(each)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = url_filter.judge(df, rules).where("rule is null and path rlike '^/(bad|good)/'").collect()
        assert len(got) == 2 * 34
        assert all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in got), (sections, each)


def plain_judgement(urls, rules):
    """The method of url_filter written as loops over all levels: (host, path) to (labelled verdict or None, template, purity)."""
    pages, label = Counter(urls), {}
    for host, path in pages:
        fits = [(len(t), v) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        label[host, path] = max(fits)[1] if fits else None
    segs = {k: k[1].removeprefix("/").split("/") for k in pages}
    t = {k: () for k in pages}
    known = {k: pages[k] if label[k] else 0 for k in pages}
    bad = {k: pages[k] if label[k] == "block" else 0 for k in pages}
    for level in range(max(map(len, segs.values()))):
        total, child, told = Counter(), Counter(), Counter()
        for k in pages:
            if len(segs[k]) > level:
                total[k[0], t[k]] += pages[k]
                child[k[0], t[k], segs[k][level]] += pages[k]
                told[k[0], t[k], segs[k][level]] += known[k]
        for k in pages:
            if len(segs[k]) > level:
                c = (k[0], t[k], segs[k][level])
                t[k] += (c[2] if child[c] >= url_filter.RARE * total[c[:2]] or told[c] >= url_filter.SUPPORT else "*",)
    m = dict(t)
    for level in reversed(range(max(map(len, segs.values())))):
        n, b, pn, pb = Counter(), Counter(), Counter(), Counter()
        place = {k: (k[0], (*m[k][:level], "*", *m[k][level + 1 :])) for k in pages if len(m[k]) > level}
        for k, q in place.items():
            n[q, m[k][level]] += known[k]
            b[q, m[k][level]] += bad[k]
            pn[q] += known[k]
            pb[q] += bad[k]
        for k, q in place.items():
            x, y = n[q, m[k][level]], b[q, m[k][level]]
            p = (pb[q] + 1) / (pn[q] + 2)
            z = abs((y + p) / (x + 1) - (pb[q] - y + p) / (pn[q] - x + 1)) / math.sqrt(p * (1 - p) * (1 / (x + 1) + 1 / (pn[q] - x + 1)))
            if z < url_filter.SIMILAR:
                m[k] = q[1]
    n, b = Counter(), Counter()
    for k in pages:
        n[k[0], m[k]] += known[k]
        b[k[0], m[k]] += bad[k]
    rate = sum(bad.values()) / max(1, sum(known.values()))
    return {k: (label[k], "/".join(m[k]), (b[k[0], m[k]] + url_filter.STRENGTH * rate) / (n[k[0], m[k]] + url_filter.STRENGTH)) for k in pages}


def test_url_method_equals_plain_version(spark):
    rules = [("allow", "org/ok/"), ("block", "org/bad/"), ("block", "x.org/s/ads/"), ("allow", "x.org/s/")]
    urls = [(f"{h}.org", f"/{s}/{w}/{i % k}" + "/deep" * (i % 2 * 6)) for h in "xy" for s, w, k in (("ok", "a", 3), ("bad", "b", 40), ("s", "ads", 2), ("s", "t", 90), ("u", "ads", 60)) for i in range(120)]
    urls += [("z.org", "/" + "/".join(f"s{j}" for j in range(n))) for n in (1, 9, 30)] + [("y.org", p) for p in ("", "/", "//", "/u")]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    want = plain_judgement(urls, rules)
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        says, template, purity = want[r.host, r.path]
        assert (r.template, round(r.purity, 9)) == (template, round(purity, 9))
        assert r.verdict == (says or ("block" if purity >= url_filter.REJECT else "allow"))


def test_verdicts_do_not_depend_on_the_depth(spark):
    """Two branches, mostly decided by rules, right below the host and under six segments."""
    seen = []
    for above in ("", "/a/b/c/d/e/f"):
        rules = [("block", f"org{above}/bad/1"), ("allow", f"org{above}/good/1")]
        rows = [(i, f"http://x.org{above}/{b}/{i % 9}{i}") for b in ("bad", "good") for i in range(300)]
        got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
        seen.append(sorted((r.path.removeprefix(above), r.verdict) for r in got))
    assert seen[0] == seen[1] and {p.split("/")[1] + v for p, v in seen[0]} == {"badblock", "goodallow"}


def test_warc_headers(spark, tmp_path):
    rows = [(1, "http://a.org/x y\r\nX: 1/\u00fc", "p" * 10), (2, None, "q"), (None, "", None), (4, "http://b.org/", "q")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), chunk=4)
    text = "".join(r.value for r in spark.read.option("lineSep", "\r\n\r\n").text(str(tmp_path / "w")).collect())
    for line in ("http://a.org/x%20y%0D%0AX:%201/%C3%BC", "urn:page:2", "urn:page:", "http://b.org/"):
        assert f"WARC-Target-URI: {line}\r\n" in text
    assert text.count("Content-Type: text/html; charset=utf-8\r\n") == 3 and text.count("WARC-Type: revisit") == 1
    assert text.count("WARC-Target-URI: http://a.org") == text.count("WARC-Segment-Number") == 3
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in warc.read_records(spark, str(tmp_path / "w")).collect()} == {
        (1, 10, "response"), (2, 1, "response"), (None, 0, "response"), (4, 1, "revisit"),
    }


def test_fingerprints(spark, odd, odd_rows, empty):
    rows = fingerprint.with_next(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    got = {r.doc_id: r for r in rows.select("*", fingerprint.fingerprint(F.col("text")).alias("own"), fingerprint.fingerprint(F.col("edited")).alias("changed")).collect()}
    plain = {r[0]: r[1] or "" for r in odd_rows if r[0] is not None}
    order = sorted(plain)
    for k, i in enumerate(order):
        t, after = plain[i], plain[order[(k + 1) % len(order)]]
        q = len(t) // 4
        assert got[i].edited == t[: len(t) - q] + after[:q] and got[i].n_chars == len(t)
        assert got[i].next_fingerprint == got[order[(k + 1) % len(order)]].own
    assert got[6].own == got[7].own != got[8].own
    assert fingerprint.with_next(odd).count() == len(odd_rows)
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(odd.where("doc_id = 1")).first()
    assert one.edited == plain[1][: len(plain[1]) - len(plain[1]) // 4] + plain[1][: len(plain[1]) // 4]


def test_likeness_and_changed_paragraphs(spark):
    a = "\n".join(f"Line {i} says something of its own. And more." for i in range(40))
    b = a.replace("Line 7 says", "Line seven said")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    got = row.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("near"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same"), fingerprint.changed_paragraphs(F.col("a"), F.col("b")).alias("where")).first()
    assert got.same == 1 and 0.9 < got.near < 1 and got["where"] == [8]


def plain_print(text):
    """The tree built upwards from its stored children."""
    def h(s, digits=16):
        return xxhash.xxh64(s.encode(), seed=42).hexdigest().upper()[:digits]

    sections, paragraphs, leaves = [], [], []
    for section in re.split(r"(?<=\n\n)(?=[^\n])", text or ""):
        rows = [re.findall(r"(?:[^ \n.!?]{1,24} *){1,4}[ \n.!?]*|[ \n.!?]+", p) for p in re.split(r"(?<=\n)(?=[^\n])", section)]
        assert "".join(sum(rows, [])) == section
        leaves.append(",".join("".join(h(x, 8) for x in r) for r in rows))
        paragraphs.append(",".join(h(x) for x in leaves[-1].split(",")))
        sections.append(h(paragraphs[-1]))
    return ":".join([h(",".join(sections)), ",".join(sections), ";".join(paragraphs), ";".join(leaves)])


def plain_likeness(a, b):
    x, y = (set(re.findall("[^,;]{8}", p.split(":")[3])) for p in (a, b))
    return 1.0 if a.split(":")[0] == b.split(":")[0] else 2 * len(x & y) / max(len(x) + len(y), 1)


def test_fingerprint_is_one_tree_at_every_length(spark):
    words = random.Random(5)
    base = " ".join("".join(words.choices("abcdefgh", k=words.randint(2, 9))) + words.choice(["", "", "", "."]) for _ in range(400))
    texts = ["", None, "\n", "\n\n\nx", "a\n\nb\n", "a\n\n\nb", "a\nb", "é😀 " * 30, "x" * 500, "One. Two!  Three?\n\n", "a. " * 5000, *[base[:n] for n in (20, 500, 508, 516, 520, 2000)]]
    edited = [(t or "")[:-20] + "here it ends anew on" for t in texts]
    rows = spark.createDataFrame(list(zip(texts, edited)), "a string, b string").select("a", "b", fingerprint.fingerprint(F.col("a")).alias("pa"), fingerprint.fingerprint(F.col("b")).alias("pb"))
    got = rows.select("*", fingerprint.likeness(F.col("pa"), F.col("pb")).alias("near")).collect()
    for r in got:
        assert r.pa == plain_print(r.a) and r.pb == plain_print(r.b)
        assert r.near == pytest.approx(plain_likeness(r.pa, r.pb))
    near = {len(r.a or ""): r.near for r in got if r.a and base.startswith(r.a)}
    assert min(near[n] for n in (500, 508, 516, 520)) > 0.8 and max(near[n] for n in (500, 508, 516, 520)) - min(near[n] for n in (500, 508, 516, 520)) < 0.05
    assert len({r.pa.split(":")[0] for r in got}) == len(texts) - 1  # null is empty


def test_moved_paragraphs_are_located(spark):
    lines = [f"Line {i} says something of its own.\n" for i in range(30)]
    swapped = lines[:]
    swapped[4], swapped[20] = lines[20], lines[4]
    cases = [("".join(lines), "".join(swapped), [5, 21]), ("".join(lines), "".join(lines[:9] + ["new\n"] + lines[9:]), []), ("".join(lines), "".join(lines[:9] + lines[11:]), [10, 11]), ("a\n\nb\nc", "a\n\nB\nc", [2]), ("same", "same", []), ("", "x", [1]), ("a\na\na\n", "a\na\n", [3])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = rows.select("i", fingerprint.changed_paragraphs(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("at")).orderBy("i").collect()
    assert [r["at"] for r in got] == [c[2] for c in cases]


def test_mixing_reaches_its_weights(spark, odd, empty):
    rows = [(i, "x" * 50, "big" if i % 3 else "small") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert n["small"] == pytest.approx(4500, rel=0.05) and n["big"] == pytest.approx(1500, rel=0.1)
    assert set(r.source for r in mixing.mix(docs, {"big": 2.0}).select("source").distinct().collect()) == {"big"}
    again = [sorted((r.doc_id, r.copy) for r in mixing.mix(docs.repartition(k), total=100_000.0).collect()) for k in (1, 5)]
    assert again[0] == again[1]
    mixed = mixing.mix(odd)
    assert set(mixed.columns) == {*odd.columns} and all(1 <= r.copy <= r.copies for r in mixed.collect())
    assert mixing.mix(empty).count() == 0


def test_poisson_of_a_large_rate(spark):
    docs = spark.createDataFrame([(1, "abcd", "s"), (2, "abcd", None)], "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in mixing.mix(docs, total=16_000.0).groupBy("source").count().collect()}
    assert got["s"] == pytest.approx(2000, rel=0.1) and got[None] == pytest.approx(2000, rel=0.1)
