from starloom.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_removed string"


def brute(rows, min_sites=3):
    sites = {}
    for _, text, source, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip(line_dedup.BLANKS):
                sites.setdefault(line.strip(line_dedup.BLANKS), set()).add(source or "")
    out = []
    for doc, text, _, _ in rows:
        lines = (text or "").split("\n")
        wide = [len(sites.get(ln.strip(line_dedup.BLANKS), ())) >= min_sites for ln in lines]
        if text is None or sum(len(ln) for ln, w in zip(lines, wide) if w) > 0.5 * len(text):
            wide = [False] * len(lines)
        out.append((doc, None if text is None else "\n".join(ln for ln, w in zip(lines, wide) if not w), sum(wide)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    body = "this line is only here number {} and says a lot of things that nobody else says"
    rows = [(i, f"Share this page\n{body.format(i)}\n  All rights reserved \n{body.format(-i - 1)}", f"s{i % 4}", "x") for i in range(12)]
    rows += [(20, "Share this page", "s9", None), (21, None, "s1", None), (22, "", "s1", None), (23, "\n \n", None, None),
             (24, "Share this page\nAll rights reserved\nx", "s2", None), (25, body.format(0), "s0", None), (25, body.format(0), "s0", None),
             (26, body.format(99) + "\nShare this page" * 3, None, None), (None, body.format(5) + "\nShare this page", "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.remove_boilerplate(df, min_sites=3).collect()
    assert sorted([(r.doc_id, r.text, r['__l_n_removed']) for r in got], key=str) == brute(rows)


def test_near_threshold_is_exact(spark):
    rows = [(i, f"on {k} sites\nown text of document number {i}, long enough to stay the larger part", f"s{s}", "")
            for i, (k, s) in enumerate((k, s) for k in (7, 8, 9) for s in range(k))]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=8).collect()
    assert all((r['__l_n_removed'] == 1) == (not rows[r.doc_id][1].startswith("on 7")) for r in out)


def test_native_plan_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    plan = line_dedup.remove_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_only_copies_stay_whole(spark):
    notice = "This work is licensed to everybody, under the terms of a licence.\nAll rights reserved."
    copied = "the copied story of many sites\nits second line"
    rows = [(i, f"{notice}\nown text {i}", f"s{i}", "") for i in range(4)] + [(4, notice, "s1", "")]
    rows += [(10 + i, copied if i % 2 else copied + "\n\n", f"s{i}", "") for i in range(4)]
    rows += [(20 + i, "All rights reserved.\npair", f"s{i}", "") for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r["__l_n_removed"]) for r in line_dedup.remove_boilerplate(df, min_sites=3, copies_only=True).collect()}
    assert all(got[i] == (f"own text {i}", 2) for i in range(4)) and got[4] == ("", 2)
    assert all(got[i] == (t, 0) for i, t, _, _ in rows if 10 <= i < 20)
    assert all(got[i] == ("pair", 1) for i in (20, 21))


def brute_copies(rows, min_sites):
    """The registered rule: a text made mostly of widespread lines stays whole only
    where such texts of the very same lines are on ``min_sites`` sites."""
    def lines_of(text):
        return [ln.strip(line_dedup.BLANKS) for ln in (text or "").split("\n")]

    sites, copies = {}, {}
    for _, text, source, _ in rows:
        for line in lines_of(text):
            if line:
                sites.setdefault(line, set()).add(source or "")
    wide = [[bool(ln) and len(sites[ln]) >= min_sites for ln in lines_of(r[1])] for r in rows]
    mostly = [r[1] is not None and sum(len(ln) for ln, w in zip(r[1].split("\n"), m) if w) > 0.5 * len(r[1]) for r, m in zip(rows, wide)]
    for (_, text, source, _), m in zip(rows, mostly):
        if m:
            copies.setdefault(frozenset(lines_of(text)) - {""}, set()).add(source or "")
    out = []
    for (doc, text, _, _), w, m in zip(rows, wide, mostly):
        if text is None or (m and len(copies[frozenset(lines_of(text)) - {""}]) >= min_sites):
            w = [False] * len(w)
        out.append((doc, None if text is None else "\n".join(ln for ln, x in zip(text.split("\n"), w) if not x), sum(w)))
    return sorted(out, key=str)


def test_registered_rule_against_brute_force(spark):
    import random
    rng = random.Random(8)
    shared = [f"shared line number {i} of this collection" for i in range(12)]
    rows = []
    for i in range(120):
        own = [f"own {i} {j} " + "text " * rng.randrange(12) for j in range(rng.randrange(3))]
        some = rng.sample(shared, rng.randrange(4)) if i % 3 else shared[i % 4:i % 4 + 3]
        lines = own + some + rng.choice([[], [""], ["  "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) if i % 40 else None, rng.choice([None, *(f"s{k}" for k in range(9))]), "x"))
    rows += rows[5:8]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=4, copies_only=True).collect()
    expected = brute_copies(rows, 4)
    assert sorted([(r.doc_id, r.text, r["__l_n_removed"]) for r in got], key=str) == expected
    assert any(n for _, _, n in expected) and any(t and not n for _, t, n in expected)
