from pulseframe.llm import hosts
from tests.llm.fixtures import frame, rows, words


def brute(data):
    out = []
    for doc, text, _, source in data:
        w, text = words(text), text or ""
        places = {}
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((doc, source, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed))
    by = {}
    for r in out:
        by.setdefault(r[1], []).append(r[-1])
    n, bad = len(out), sum(r[-1] for r in out)
    mean = bad / n
    spread = sum(len(f) * (sum(f) / len(f) - mean) ** 2 for f in by.values())
    chance, den = mean * (1 - mean), n - sum(len(f) ** 2 for f in by.values()) / n
    between = (spread - chance * (len(by) - 1)) / den if den else 0
    rate = {}
    for s, f in by.items():
        if len(by) > 1 and 0 < between < chance:
            m = chance / between - 1
            rate[s] = (sum(f) + m * mean) / (len(f) + m)
        else:
            rate[s] = sum(f) / len(f) if den and between >= chance else mean
    return sorted(((*r[:1], *r[2:], not r[-1] and rate[r[1]] <= 0.5) for r in out), key=str)


def test_measures_and_verdicts(spark):
    line = "a line of words that repeats\n"
    data = rows(n=120) + [(2000 + i, "<b>| ## 100% |</b> " * 30 if i % 3 else line * 9 + "end # " + str(i), "en", "bad") for i in range(20)]
    data += [(2100, " ".join(rows()[1][1].split() * 2), "en", "bad"), (2101, "w1 w2 w3 " * 5 + " ".join(f"u{i}" for i in range(60)), "en", "fine")]
    got = hosts.host_rules(frame(spark, data)).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=str)
    assert have == brute(data)


def test_few_hosts_and_rows(spark):
    for data in (rows()[:1], [(1, None, "en", None)], [(1, "x " * 60, "en", "a"), (2, None, "en", "b")]):
        got = hosts.host_rules(frame(spark, data)).collect()
        assert sorted((r.doc_id, r.kept) for r in got) == sorted((r[0], r[-1]) for r in brute(data))
    assert hosts.host_rules(frame(spark, rows()).limit(0)).count() == 0
