import random
import re

from roadpulse.llm import licences


def test_base_scan_and_templates(make, corpus):
    rows = corpus + [
        (500, "x\nLicensed under the Apache License, Version 2.0.\ny"), (501, "This work is licensed under the GNU General Public License, version 3."),
        (502, "Released under the MIT License."), (503, "Licensed under CC BY-NC 4.0. cc by"), (504, "apache"), (505, "mit apache license"), (506, "gnu general public"),
        (507, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (507, "Licensed under the Apache License, Version 2.0"),
    ]
    out = licences.scan(make(rows)).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in out:
        fits = []
        for t in texts[r.doc_id]:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            found = [(k, label) for phrase, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
            fits.append((len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in fits
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in out}
    assert by[500].labels == "apache,apache-2.0" and by[500].score == 1.0
    assert by[501].labels == "gpl,gpl-3.0" and by[503].labels == "cc-by,cc-by-nc-4.0" and by[504].labels == ""
    assert licences.scan(make([])).collect() == []


def test_no_python_on_the_executors(make, corpus):
    plan = licences.scan(make(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_with_several_notices(make):
    notices = [t.notice.replace("[", "").replace("]", "") for t in licences.TEMPLATES]
    rare = "redistribution forms permission hereby charge copy obtaining modification attribution mozilla"
    rows = [(1, ". ".join(notices)), (2, ". ".join(reversed(notices))), (3, f"{notices[4 + 1]}. {notices[6]}"), (4, f"{rare} licensed under the apache license version 2 0"), (5, "cc by 4 0")]
    rows += [(10 + k, n) for k, n in enumerate(notices)] + [(100 + k, "apache license") for k in range(30)] + [(200 + k, notices[6]) for k in range(30)]
    by = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(make(rows)).collect()}
    every = {t.label for t in licences.TEMPLATES}
    assert every <= by[1] and every <= by[2]
    assert by[3] == {"mit", "bsd-3-clause"} and by[4] == {"apache", "apache-2.0"} and by[5] == {"cc-by", "cc-by-4.0"}
    assert all(t.label in by[10 + k] for k, t in enumerate(licences.TEMPLATES))


def brute(text):
    """Labels and score by holding every template against every place of a text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels = {label for phrase, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()}
    best = 0.0
    for t in licences.TEMPLATES:
        for start in range(-len(t.words), len(w)):
            at = lambda k: w[start + k] if 0 <= start + k < len(w) else ""  # noqa: B023, E731
            if all(at(k) == t.words[k] for k in t.key):
                score = sum(at(k) == x for k, x in enumerate(t.words)) / len(t.words)
                if score >= licences.LEAST_SCORE:
                    labels.add(t.label)
                    best = max(best, score)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_match_brute_force(make, corpus):
    r = random.Random(4)
    notices = [t.notice.replace("[", "").replace("]", "") for t in licences.TEMPLATES]
    rows = [(i, t) for i, t in corpus if not t or len(t) < 5000] + [(1000 + k, n) for k, n in enumerate(notices)]
    for k in range(150):  # notices with words changed, dropped and added, several in a text
        words = " ".join(r.choice(notices) for _ in range(r.randint(1, 3))).split()
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice(([], ["Word"], [words[at], "license"], [words[at].upper()], ["gnu", words[at]]))
        rows.append((2000 + k, " ".join(words)))
    rows += [(5000, "the gnu " * 3000 + "released under the MIT license" + " x" * 9000), (5001, "mit" * 5000)]
    for x in licences.scan(make(rows)).collect():
        labels, score = brute(dict(rows)[x.doc_id])
        assert x.labels == labels and abs(x.score - score) < 1e-12, x.doc_id
