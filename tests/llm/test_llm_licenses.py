"""License notices told apart, mandatory phrases, and frequencies over the corpus."""

import math
from collections import Counter

import pytest

from urlsieve.llm import licenses

NOTICES = [
    ('This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/', 'epl-2.0'),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose", 'zlib'),
    ('To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.', 'cc0-1.0'),
    ('This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.', 'gpl,lgpl,lgpl-2.1'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or', 'gpl,gpl-3.0'),
    ('This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or', 'gpl,gpl-2.0'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or', 'agpl,agpl-3.0,gpl'),
    ('This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.', 'cc-by-sa'),
    ('This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.', 'cc-by-nc-nd'),
    ('This work is licensed under a Creative Commons Attribution 4.0 International License.', 'cc-by'),
    ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form', 'bsd-2-clause'),
    ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.', 'bsd-3-clause'),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge', 'mit'),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 'apache-2.0'),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.', 'isc'),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS"', '0bsd'),
    ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed', 'mpl-2.0'),
    ('released CC BY 4.0 today', 'cc-by'),
    ('the software is a product of the author and any person may use it under the terms', ''),
    ('licensed under CC BY-NC-SA 4.0', 'cc-by,cc-by-nc-sa'),
]
INDEX = licenses.LicenseIndex()


@pytest.mark.parametrize("text,labels", NOTICES)
def test_notices_are_told_apart(text, labels):
    around = "some words before it " * 30 + text + " and some words after it" * 30
    for t in (text, text.upper(), around):
        row = INDEX.scan(t)
        assert row[5] == labels and 0 <= row[6] <= 1 and (row[6] > 0.6) == bool(labels)


def test_a_notice_without_its_phrase_is_none():
    assert INDEX.scan("This program and the accompanying materials are made available under the terms of the Example Public License 2.0")[5] == ""
    # the score is the method's: a base phrase alone has a label and none
    assert INDEX.scan("see the general public license there")[4:] == ("gpl", "gpl", 0.0)


def test_brute_force_alignment():
    """Every notice at every start, without an index."""
    text = " x ".join(t for t, _ in NOTICES)
    words = licenses.words_of(text)
    brute = set()
    for label, notice, keys in INDEX.notices:
        total = sum(INDEX.weight[w] for w in notice)
        for start in range(-len(notice), len(words)):
            got = sum(INDEX.weight[w] for k, w in enumerate(notice) if 0 <= start + k < len(words) and words[start + k] == w)
            if got >= INDEX.share * total and all(INDEX._stands(words, start + at, key) for at, key in keys):
                brute.add((label, start))
    at_of = {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
    assert {(label, start) for label, start, _, _ in INDEX.found(words, at_of)} == brute


def test_frequencies_are_those_of_the_corpus(spark):
    rows = [("license license",), ("LICENSE",), ("apache",), (None,), ("nothing",)]
    idf = licenses.corpus_idf(spark.createDataFrame(rows, "text string").repartition(3))
    want = Counter({b"license": 2, b"apache": 1})
    assert all(math.isclose(v, math.log(6 / (1 + want[w])) + 0.1) for w, v in idf.items()) and b"nothing" not in idf
    empty = licenses.corpus_idf(spark.createDataFrame([], "text string"))
    assert licenses.LicenseIndex(empty).scan(NOTICES[0][0])[5] == "epl-2.0"


def test_a_long_text_of_notices():
    text = "Released under the MIT License. All rights reserved. " * 4000
    assert INDEX.scan(text)[1:6] == (4000, 5, 8 * 3999 + 5, "reserved", "mit,reserved")
