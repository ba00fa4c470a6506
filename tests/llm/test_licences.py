import re

from corpusloom.llm import licences


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def words_of(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def pairs(w):
    return {f"{x} {y}" for x, y in zip(w[:-1], w[1:], strict=True)}


def brute(text):
    """Name -> coefficient, by all units and by the windows of all places."""
    best = {}
    low = text.lower()
    paragraphs = re.split(r"\n[\x20\t\r]*\n", low)
    telling = "\n\n".join(p for p in paragraphs if set(words_of(p)) & set(licences._clues()))
    legal = "\n\n".join(p for p in paragraphs if any(w in p for w in licences.LEGAL_WORDS))
    forms = {n: (set(licences.template_bigrams(t)), len(licences.template_words(t)), set(licences.numbers_of(n, t))) for n, t in licences.TEMPLATES.items()}
    for u in set(low.split("\n")) | set(re.sub(r"([.!?])[ \t]+", r"\1\n", low).split("\n")) | set(paragraphs) | {low, telling, legal}:
        w = words_of(u)
        scored = {n: dice(pairs(w), b) for n, (b, _, numbers) in forms.items() if pairs(w) and numbers <= set(w)}
        near = {n: d for n, d in scored.items() if d >= licences.DICE - 1e-9}
        for n, d in near.items():
            if d >= max(near.values()) - 1e-9:
                best[n.split("#")[0]] = max(best.get(n.split("#")[0], 0), d)
    w, hits = words_of(low), []
    notices = sorted(n for n in forms if n not in licences.WHOLE)
    for t, n in enumerate(notices):
        b, size, numbers = forms[n]
        for s in range(len(w) - size + 1):
            own = w[s : s + size]
            if numbers <= set(own) and dice(pairs(own), b) >= licences.DICE - 1e-9:
                hits.append((len(pairs(own) & b), dice(pairs(own), b), -t, -s, s + size, n.split("#")[0]))
    for h in hits:
        if not any((min(g[4], h[4]) - max(-g[3], -h[3])) * 2 > min(g[4] + g[3], h[4] + h[3]) and g[:4] > h[:4] for g in hits):
            best[h[5]] = max(best.get(h[5], 0), h[1])
    return best


NOTICES = {
    "This project is released under the MIT License, see the LICENSE file for details.": {"MIT"},
    "Licensed under the Apache License, Version 2.0 or the MIT license at your option.": {"Apache-2.0", "MIT"},
    "MIT License": {"MIT"},
    "SPDX-License-Identifier: Apache-2.0": {"Apache-2.0"},
    "CC BY 4.0": {"CC-BY-4.0"},
    "Released under the BSD 2-Clause License.": {"BSD-2-Clause"},
    "Licensed under the Eclipse Public License 2.0.": {"EPL-2.0"},
    licences.TEMPLATES["AGPL-3.0-header"]: {"AGPL-3.0-header"},
    "we do. " * 30 + licences.TEMPLATES["AGPL-3.0-header"] + " and so on" * 30: {"AGPL-3.0-header"},
    licences.TEMPLATES["LGPL-2.1-header"]: {"LGPL-2.1-header"},
    licences.TEMPLATES["GPL-2.0-header"]: {"GPL-2.0-header"},
    "under the terms of the GNU Lesser General Public License, version 3, by us": {"LGPL-3.0"},
    "GNU General Public License version 1": set(),
    "I submit my licence to the court and mit der Lizenz": set(),
}
TEXTS = ["prose\nReleased under the MIT License.\nmore", "Released under the  mit-license!", "This work is licensed under the GNU General Public License version 3", "nothing", "", None, "mit", "# " + licences.TEMPLATES["MIT-text"].replace(" ", "\n", 9) + " extra words", licences.TEMPLATES["Apache-2.0-header"] + "\n\nLicensed under CC BY-NC 4.0.", "license " * 500, *NOTICES]


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licences.scan_licences(df).collect():
        want = brute(TEXTS[r.doc_id] or "")
        assert r.licences == ",".join(f"{n}:{int(d * 10000 + 1e-6)}" for n, d in sorted(want.items())), r.doc_id
        assert r.n_licences == len(want) and (r.best_licence is None) == (not want)
        if (named := NOTICES.get(TEXTS[r.doc_id])) is not None:
            assert set(want) == named


def test_long_texts_without_the_word_license(spark):
    """No template depends on one word."""
    text = re.sub("(?i)licen[sc]e", "grant", licences.TEMPLATES["BSD-3-Clause-text"]) + "\n\n" + licences.WHOLE["CC0-1.0-text"].replace("license", "grant").replace("License", "Grant")
    got = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().licences
    assert "BSD-3-Clause-text:10000" in got and "CC0-1.0-text" in got


def test_filter_loses_nothing():
    for t in licences.TEMPLATES.values():
        b = licences.template_bigrams(t)
        clues = licences.telling_words(b, licences.DICE)
        assert sum(not clues & set(x.split(" ")) for x in b) < licences.least_common(len(b), licences.DICE)


def test_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 3), (1, "Released under the MIT License.", 3)], "doc_id long, text string, licences int")
    out = licences.scan_licences(df).collect()
    assert len(out) == 2 and out[0].licences == "MIT:10000" and out[0].best_dice == 1.0
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_native(spark, sf_dir):
    plan = licences.op5_licence_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def real_licences():
    """Licence files of installed packages, by what they are known to be."""
    from importlib.metadata import PackageNotFoundError, files

    known = {"pytest": "MIT-whole", "attrs": "MIT-whole", "regex": "Apache-2.0-text", "hypothesis": "MPL-2.0-text", "iniconfig": "MIT-whole", "pandas": "BSD-3-Clause", "pygments": "BSD-2-Clause-text"}
    for name, licence in known.items():
        try:
            found = [f for f in files(name) or [] if re.search(r"(^|/)LICEN[CS]E(\.txt|\.md)?$", str(f))]
        except PackageNotFoundError:
            continue
        for f in found[:1]:
            yield name, licence, f.locate().read_text(encoding="utf-8")


def test_real_files_whole_and_within_longer_texts(spark):
    prose = "Some words about a project that helps people read. " * 30
    cases = list(real_licences())
    assert len({c[1] for c in cases}) >= 2
    rows = [(name, licence, text) for name, licence, text in cases] + [(f"{name} within", licence, f"{prose}\n\n{text}\n\n{prose}") for name, licence, text in cases if len(text) < 4000]
    got = {r.n: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "n string, l string, text string")).collect()}
    for name, licence, _ in rows:
        assert licence in got[name], (name, got[name])


def test_notice_within_prose_and_long_texts(spark):
    rows = [(1, "It helps you. Released under the MIT License. See more."), (2, licences.TEMPLATES["GPL-3.0-text"]), (3, "prose " * 50_000 + "\n\n" + licences.TEMPLATES["Apache-2.0-text"]), (4, None), (5, "")]
    got = {r.n: r for r in licences.scan_licences(spark.createDataFrame(rows, "n int, text string")).collect()}
    assert got[1].licences == "MIT:10000" and "GPL-3.0-text:10000" in got[2].licences and "Apache-2.0-text" in got[3].licences
    assert got[4].n_licences == got[5].n_licences == 0
