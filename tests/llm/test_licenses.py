import random
import re

from quillstream.llm import licenses as li


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_scan_equals_brute_force(spark):
    r = random.Random(5)
    names = list(li.TEMPLATES)
    word = lambda: r.choice(["the", "license", "under", "version", "é", "x1", "file", "may", "2", "0"])
    docs = []
    for i in range(250):
        body = [word() for _ in range(r.randint(0, 60))]
        at = r.randint(0, len(body))
        if i % 3:
            passage = li.TEMPLATES[names[i % len(names)]].split()
            if i % 5 == 0:
                passage[r.randrange(len(passage))] = "other"
            if i % 7 == 0:
                passage = [w.upper() for w in passage]
            body = body[:at] + passage + body[at:]
        docs.append((i, " ".join(body), "clash"))
    docs += [(300, None, "x"), (301, "", "x"), (302, "four words are here", "x"), (1, docs[1][1], "x"), (303, "released under the mit license", "x"), (None, docs[1][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, license string")
    got = sorted((x.doc_id, x.license, x.n_shared, x.n_shingles) for x in li.scan(frame).collect())
    want = []
    for d, t, _ in docs:
        for name, body in li.TEMPLATES.items():
            g = grams(body)
            n = len(g & grams(t))
            if d is not None and n >= li.CONTAINMENT * len(g):
                want.append((d, name, n, len(g)))
    assert got == sorted(want) and len({w[1] for w in want}) == len(names)
    assert li.scan(frame.limit(0)).count() == 0


def test_plan_has_no_python(spark, capsys):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    li.scan(frame).explain("simple")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan)
