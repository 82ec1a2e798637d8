"""Licence scans: wrapped texts, sentences in another sense, and the scoring against a plain implementation."""

import math
import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import license_scan as scan_of
from leafmill.llm.common import table

SF = "/root/testdata/sf0.001"
WRAPPED = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", 'of this software and associated documentation files (the "Software"), to deal': "MIT",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM": "MIT", "Redistribution and use in source and binary forms, with or without": "BSD",
    "you may not use this file except in compliance with the License.": "Apache-2.0", "The Unlicense: this is free and unencumbered software released into the public domain.": "Unlicense",
    "Licensed under the ISC License": "unknown", "She studied at MIT under a famous teacher.": None,
}
OTHERS = ["Apache tribes license their land under treaties.", "Veröffentlicht unter MIT-Lizenz", "The software is used in the house without any limitation of kind."]


@pytest.fixture(scope="module")
def model(spark):
    return scan_of.train(table(spark, SF, "documents"))


def plain_scan(model, text):
    """[(paragraph, license, probability, shared)] of one text."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        words = [w for w in re.split(r"[^\w]+|_", line.lower()) if w]
        if not words:
            continue
        found = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        z = list(model.intercept)
        for g in found & set(model.weights):
            z = [a + b for a, b in zip(z, model.weights[g], strict=True)]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        p = [x / sum(e) for x in e]
        if p[0] >= max(p[1:]):
            continue
        best = max(range(2, len(p)), key=lambda i: (p[i], i))
        names, clauses = scan_of.FAMILIES[scan_of.CLASSES[best]]
        shared = 0.0
        for t in names:
            g = set(scan_of._grams_of(t))
            if g <= found and (len(g) > 1 or found & set(scan_of.SAYING)):
                shared = 1.0
        for t in clauses:
            g = set(scan_of._grams_of(t))
            if len(g & found) >= scan_of.LEAST_GRAMS:
                shared = max(shared, len(g & found) / min(len(g), len(found)))
        sure = p[best] > model.bound and shared >= scan_of.MIN_SHARED
        out.append((k, scan_of.CLASSES[best] if sure else "unknown", round(p[best], 9), round(shared, 9)))
    return out


def test_scan_equals_plain_scoring(spark, model):
    odd = [*WRAPPED, *OTHERS, "", "\n\n", "GPL\nunder GPL\nSPDX-License-Identifier: MIT", "All rights reserved. " * 40]
    d = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*odd, None])], "doc_id long, text string").unionByName(table(spark, SF, "documents").select("doc_id", "text"))
    got = sorted((r["doc_id"], r["paragraph"], r["license"], round(r["probability"], 9), round(r["shared"], 9)) for r in scan_of.scan(d, model).collect())
    assert got == sorted((r["doc_id"], *x) for r in d.collect() for x in plain_scan(model, r["text"]))


def test_wrapped_texts_and_other_senses(spark, model):
    lines = [*WRAPPED, *OTHERS]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id int, text string")
    got = {lines[r["doc_id"]]: r["license"] for r in scan_of.scan(d, model).collect()}
    assert {t: got.get(t) for t in WRAPPED} == WRAPPED
    assert got[OTHERS[0]] == "unknown" and got[OTHERS[1]] in ("MIT", "unknown") and got.get(OTHERS[2]) in (None, "unknown")


def test_lines_of_clauses_cover_them():
    for _, clauses in scan_of.FAMILIES.values():
        for t in clauses:
            lines = scan_of.wrapped(t)
            assert set(" ".join(lines).split()) == set(t.split()) and max(len(x.split()) for x in lines) <= scan_of.LINE_WORDS


def test_names_stand_whole(spark):
    d = spark.createDataFrame([("apache license",), ("apache tribes license",), ("a mit thing",), ("mit license",), ("under the apache license version 2 0",)], "t string")
    family = F.when(F.col("t").contains("apache"), "Apache-2.0").otherwise("MIT")
    got = d.select("t", scan_of.shared_with_template(scan_of.grams(scan_of.tokens(F.col("t"))), family).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == {"apache license": 1.0, "apache tribes license": 0.0, "a mit thing": 0.0, "mit license": 1.0, "under the apache license version 2 0": 1.0}
