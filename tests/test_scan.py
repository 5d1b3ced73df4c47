"""A tree of JSON files in, tables out, with numbers worked out by hand."""

import json

import pytest

from phrasemill.plans import scan

TEXT = "Graph based ranking of candidate keyphrases. We study neural networks for extraction, and a neural, network view."
GOLD = ["graph ranking", "neural network", "Neural Networks", "...", "keyphrase extraction", "deep learning", "graph mining"]
RANKED = ["neural networks", "graph ranking", "réseaux de neurones", "unrelated"]


def _write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


@pytest.fixture(scope="module")
def two_languages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    card = {"document": {"body": {"type": ["text"], "languages": ["en"]}}, "annotations": {"author": {"languages": ["en"]}, "reader": {"language": "fr"}}}
    _write(root / "documents" / "document.two.json", card)
    (root / "documents" / "document.broken.json").write_text("{")
    one = {"_id": "d1", "metadata": {"split": "test"}, "sections": [{"field": "body", "content": TEXT}], "annotations": [{"annotator": "author", "keyphrases": GOLD}, {"annotator": "reader", "keyphrases": ["réseaux de neurones"]}]}
    other = one | {"_id": "d2", "metadata": {"split": "train"}, "annotations": one["annotations"][:1]}
    again = one | {"annotations": [{"annotator": "author", "keyphrases": ["something else"]}]}
    _write(root / "documents" / "document.two.jsonl", one, other, again)
    run = root / "inferences" / "two" / "m" / "a" / "r1"
    _write(run / "run_r1.json", {"parameters": {}})
    _write(run / "batch_00000.jsonl", *({"_id": i, "inferences": p, "costs": {"time": 1.0}} for i, p in (("d1", RANKED), ("d2", RANKED), ("d1", ["unrelated"]))))
    return scan.scan(spark, str(root))


def test_gold_is_classified_once(two_languages):
    gold = two_languages.gold.where("doc_id = 'd1'").collect()
    author = sorted((r.kp_idx, r.surface, r.prmu) for r in gold if r.ann_key == "author")
    assert author == [(0, "graph ranking", "R"), (1, "neural network", "P"), (2, "keyphrase extraction", "R"), (3, "deep learning", "U"), (4, "graph mining", "M")]
    assert [(r.surface, r.prmu) for r in gold if r.ann_key == "reader"] == [("réseaux de neurones", "U")]
    assert sorted(r.kp_idx for r in gold if r.ann_key == "@combined") == list(range(6))
    present = next(r for r in gold if r.ann_key == "author" and r.prmu == "P")
    assert TEXT[: present.end_char].endswith("neural networks")
    assert two_languages.gold.where("doc_id = 'd2'").isEmpty()  # a training document without flags
    issues = two_languages.issues.first()
    assert (issues.gold_duplicates, issues.gold_empty, issues.duplicate_doc_ids, issues.bad_lines) == (2, 2, 1, 0)
    assert two_languages.documents.where("doc_id = 'd1'").count() == 1 and len(two_languages.wrong) == 1


def test_scores(two_languages):
    got = {r.ann_key: (r.p_mean, r.r_mean, r.n) for r in two_languages.metrics.where("k = 'M'").collect()}
    assert got == {"author": (pytest.approx(0.5), pytest.approx(0.4), 1), "reader": (pytest.approx(0.25), pytest.approx(1.0), 1), "@combined": (pytest.approx(0.75), pytest.approx(0.5), 1)}


def test_tags(two_languages):
    tags = two_languages.tags.first().tags
    assert "duplicate_docs:1" in tags and "unscored:1" in tags and not any(t.startswith(("incomplete", "missing")) for t in tags)
    assert two_languages.predictions.where("doc_id = 'd1'").count() == 1


def test_sections_and_flags(spark, tmp_path):
    """No phrase crosses sections; offsets are those of the joined text; missing sections and contradicted languages are flagged."""
    _write(tmp_path / "documents" / "document.s.json", {"document": {"title": {"languages": ["en"]}, "abstract": {"language": "en"}, "notes": {"optional": True}, "summary": {}}, "annotations": {"author": {"languages": ["en"]}}})
    title, abstract = "Oncologic disease and therapy", "Récent progress on cardiovascular disease motivates this study."
    french = "Le but de la recherche est de trouver les mots dans un texte et de les classer par ordre"
    rows = [
        {"_id": "x", "metadata": {"split": "test"}, "sections": [{"field": "title", "content": title}, {"field": "abstract", "content": abstract}, {"field": "summary", "content": ""}], "annotations": [{"annotator": "author", "keyphrases": ["cardiovascular disease", "therapy récent", "oncologic disease", "disease+therapies"]}]},
        {"_id": "y", "metadata": {"split": "training"}, "sections": [{"field": "title", "content": french}, {"field": "abstract", "languages": ["fr"], "content": french}], "annotations": [{"keyphrases": ["mots"]}]},
        {"_id": None, "sections": None, "annotations": None},
        {"_id": "z", "metadata": {"split": "train"}, "sections": [{"field": f, "content": abstract} for f in ("title", "abstract", "summary")], "annotations": [{"annotator": "author", "keyphrases": ["x"]}]},
    ]
    _write(tmp_path / "documents" / "document.s.jsonl", *rows)
    found = scan.scan(spark, str(tmp_path))
    flags = {r.doc_id: r.flags for r in found.documents.collect()}
    assert flags["x"] == [] == flags["z"] and flags["y"] == ["lang_mismatch:section:title", "missing_section:summary"]
    assert [v for k, v in flags.items() if k.startswith("@")] == [["missing_section:abstract", "missing_section:summary", "missing_section:title"]]
    got = {r.display: r for r in found.gold.where("doc_id = 'x'").collect()}
    full = "\n\n".join([title, abstract])
    assert got["therapy récent"].prmu == "R" and got["oncologic disease"].prmu == "P"
    for phrase in ("cardiovascular disease", "oncologic disease"):
        assert full[: got[phrase].end_char].lower().endswith(phrase)
    assert got["disease"].prmu == "P" and got["disease"].stems == ["diseas", "therapi"] and full[: got["disease"].end_char].endswith("Oncologic disease")
    assert {r.doc_id for r in found.gold.select("doc_id").distinct().collect()} == {"x", "y"}  # flagged documents keep their gold
    assert found.predictions.isEmpty() and found.metrics.isEmpty()
