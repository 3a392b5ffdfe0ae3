import hashlib
import random
import re

from pyspark.sql import functions as F

from marginalia.llm import multiset as ms


def paragraphs(text):
    found = (p.strip(ms.SPACE) for p in re.findall(ms.PARAGRAPH, text or ""))
    return [p for p in found if p]


def counts(found):
    out = [0] * ms.LANES
    for p in found:
        digest = hashlib.sha256(p.encode()).hexdigest()
        for piece in range(ms.PIECES):
            h = int(digest[15 * piece : 15 * piece + 15], 16)
            for shift in range(15):
                for j in range(4):
                    out[4 * (15 * piece + shift) + j] += h >> shift + 15 * j & 1
    return [c % ms.MODULUS for c in out]


def coded(text):
    found, c = paragraphs(text), counts(paragraphs(text))
    return f"{len(found):08x}" + "".join(f"{sum(c[4 * k + j] << 15 * j for j in range(4)):015x}" for k in range(60))


def likeness(a, b):
    if coded(a) == coded(b):
        return 1.0
    half, lanes = ms.MODULUS // 2, []
    for t in (a, b):
        n = len(paragraphs(t))
        lanes.append([(2 * c - n + half) % ms.MODULUS - half for c in counts(paragraphs(t))])
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    both = dot(*lanes)
    return max(0.0, both / (dot(lanes[0], lanes[0]) + dot(lanes[1], lanes[1]) - both)) if both > 0 else 0.0


def brute(rows):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    out = {}
    for k, (i, text) in enumerate(order):
        next_id, follows = order[(k + 1) % len(order)]
        take = len(text) // 4
        edited = text[: len(text) - take] + follows[:take]
        out[i, text] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), coded(text), coded(edited), likeness(text, edited), likeness(text, follows), next_id)
    return sorted((out[i, t or ""] for i, t in rows), key=repr)


def corpus():
    rng = random.Random(4)
    sentence = lambda: "".join(rng.choices("abc é日👍", k=rng.randrange(1, 12))) + rng.choice([".", "!?", "...", "\n", " "])
    rows = [(k * 7 % 61, "".join(sentence() for _ in range(rng.randrange(0, 40)))) for k in range(60)]
    return [*rows, (100, None), (101, ""), (102, " \n\t"), (103, "!!!"), (104, "same. same. same."), (None, "no id."), (None, "other. no id."), (3, "third with id 3."), *[(200, "copy. of a row.")] * 3]


def test_matches_brute_force(docs_of):
    rows = corpus()
    got = sorted((tuple(r) for r in ms.likenesses(docs_of(rows)).collect()), key=repr)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[7] == b[7] and abs(a[5] - b[5]) < 1e-12 and abs(a[6] - b[6]) < 1e-12


def test_the_order_of_paragraphs_does_not_matter_and_parts_add_up(spark):
    a, b = "One two. Three!\nFour", "Five six? Seven. One two."
    rows = spark.createDataFrame([(a, b, f"{a}\n{b}", "Seven.\nOne two.\nThree!\nFour\nFive six? One two.")], "a string, b string, both string, turned string")
    for c in rows.columns:
        rows = ms.fingerprints(rows, c, f"f_{c}")
    got = rows.select(ms.added(F.col("f_a"), F.col("f_b")).alias("sum"), ms.removed(F.col("f_both"), F.col("f_b")).alias("less"), "f_a", "f_both", "f_turned", ms.encoded(F.col("f_both")).alias("hex")).first()
    assert got.sum == got.f_both == got.f_turned and got.less == got.f_a
    assert got.hex == coded(f"{a}\n{b}")


def test_insertions_and_deletions_wrap_around(spark):
    rows = ms.fingerprints(spark.createDataFrame([("x. y. z.", "q. " * 20_000)], "a string, b string"), "a", "f_a")
    rows = ms.fingerprints(rows, "b", "f_b")
    gone = ms.removed(F.col("f_a"), F.col("f_b"))
    got = rows.select(ms.added(gone, F.col("f_b")).alias("back"), "f_a", "f_b").first()
    assert got.back == got.f_a and got.f_b.n == 20_000


def test_groups_are_summed(spark):
    rows = spark.createDataFrame([(1, "a. b."), (1, "c."), (2, None), (1, "a.")], "g int, text string").repartition(3)
    got = {r.g: r.f for r in ms.summed(ms.fingerprints(rows, "text", "f"), ["g"], "f").collect()}
    want = {r.g: r.f for r in ms.fingerprints(spark.createDataFrame([(1, "c. a. b.\na."), (2, "")], "g int, text string"), "text", "f").collect()}
    assert {g: (f.n, f.lanes) for g, f in got.items()} == {g: (f.n, f.lanes) for g, f in want.items()}


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + "."
    for n, shared in ((40, 30), (40, 0), (400, 300), (400, 200), (3, 3)):
        a = [sentence() for _ in range(n)]
        b = a[:shared] + [sentence() for _ in range(n - shared)]
        rng.shuffle(b)
        rows = ms.fingerprints(ms.fingerprints(spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string"), "a", "x"), "b", "y")
        near = ms.with_likeness(rows, {"near": ("x", "y")}).first().near
        assert abs(near - shared / (2 * n - shared)) < 0.15 and (shared < n or near == 1)


def test_empty_table_single_row_clashing_names_and_long_texts(spark, docs_of):
    assert ms.likenesses(docs_of([(1, "x")]).where("doc_id = 0")).count() == 0
    odd = spark.createDataFrame([(5, "Only one text. It follows itself.", "k", 1)], "doc_id long, text string, key string, n_chars int")
    assert [tuple(r) for r in ms.likenesses(odd).collect()] == brute([(5, "Only one text. It follows itself.")])
    taken = spark.createDataFrame([("a. b.", "mine", 1)], "text string, paragraphs_found string, DIGEST_0 int")
    assert ms.fingerprints(taken, "text", "f").columns == ["text", "paragraphs_found", "DIGEST_0", "f"]
    rng = random.Random(2)
    long = [(1, "no end " * 300_000), (2, "".join(rng.choices("ab. \n", k=300_000))), (3, "x." * 20_000)]
    got = {r.doc_id: r for r in ms.likenesses(docs_of(long)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: coded(t) for i, t in long}
