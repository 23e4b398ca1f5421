"""Lines of one or two distinct words are deduplicated like any other."""

import re

from tidewatch.llm import line_dedup


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0d]+", line.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_short_lines_go(spark):
    texts = {
        1: "one\n\n \t\nand ornd.\nand ornd.\n\u7b2c\u4e00\u884c\u6587\u5b57",
        2: "And  ornd.\nornd. and\nONE\n\n\u7b2c\u4e00\u884c\u6587\u5b57\nla la la la la la",
        3: "la la la la la\none two\none\nla lu la lu la lu la lu",
        4: "la lu la lu la lu la lu la lu\none two\none two three\none\n",
        5: None,
    }
    seen, gone = [], set()
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            s = shingles(line)
            if any(near(s, x) for x in seen):
                gone.add((i, k))
            seen.append(s)
    assert {(1, 4), (2, 0), (2, 2), (2, 4), (3, 0), (4, 0)} <= gone and not {(1, 1), (2, 1), (2, 3), (4, 2)} & gone
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3, "doc_id")
    assert {(r.id, r.part) for r in line_dedup.later_matches(docs).collect()} == gone
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == want
