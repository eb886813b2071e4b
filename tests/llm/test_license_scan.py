from civicpulse.llm.license_scan import RULES, SENTENCES, license_scan



def scan(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return {r.id: r for r in license_scan(df).collect()}


def test_references_and_order(spark):
    r = scan(
        spark,
        "Prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
        "Released under the MIT License. Licensed under CC BY-NC 4.0!",
        "Copyright 2020 Someone.\nAll rights reserved.",
        "Copyright 2020 Someone. Words between. All rights reserved.",
        "nothing of the kind", None, "", "LICENSED UNDER CC BY 4.0\nLicensed under CC BY 4.0.",
    )
    assert [r[i].licenses for i in range(8)] == [
        ["Apache-2.0"], ["MIT", "CC-BY-NC-4.0"], ["Proprietary"], ["Proprietary"], [], [], [], ["CC-BY-4.0"]
    ]
    assert r[2].n_unmatched == 0 and r[3].n_unmatched == 1  # the copyright line stands apart
    assert [r[i].restricted for i in range(8)] == [False, True, True, True, False, False, False, False]
    assert r[7].n_sentences == 2


def test_sequences_beat_single_sentences(spark):
    text = ". ".join(SENTENCES[n][0] for n in ("mit-grant", "mit-notice", "as-is"))
    r = scan(spark, text, ". ".join(SENTENCES[n][0] for n in ("mit-notice", "mit-grant")))
    assert r[0].licenses == ["MIT"] and r[0].n_unmatched == 0
    assert r[1].licenses == [] and r[1].n_unmatched == 2


def test_every_rule_is_reachable(spark):
    texts = [". ".join(SENTENCES[n][0] for n in names) for names, _ in RULES]
    r = scan(spark, *texts)
    assert [r[i].licenses for i in range(len(RULES))] == [[x] for _, x in RULES]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""


def test_wrapped_headers(spark):
    texts = [APACHE, APACHE.replace('"License");\nyou may', '"License"); you may\n'), MIT, BSD, GPL, MPL]
    want = ["Apache-2.0", "Apache-2.0", "MIT", "BSD-2-Clause", "GPL-3.0-or-later", "MPL-2.0"]
    marks = ["", "# ", "// ", " * ", "dnl "]
    r = scan(spark, *["\n".join(m + line for line in t.split("\n")) for m in marks for t in texts])
    assert [r[i].licenses for i in range(30)] == [[x] for x in want] * 5
    assert all(r[i].sentence_ids == ["apache-you", "apache-comply", "apache-copy"] for i in (0, 1, 6, 7))
    assert not any(r[i].n_unmatched for i in range(30) if i % 6 != 2)  # MIT names a holder


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


MIT_FULL = MIT + """
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_HEAD = "BSD 2-Clause License\n\nCopyright (c) 2019, Some Body and others\nAll rights reserved.\n\n"
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_FULL = "Copyright 2021 Some Body\n\n" + APACHE + """
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_FULL = "Copyright (C) 2020  Some Body\n\n" + GPL + """

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL_FULL = MPL + "\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
ISC = """ISC License

Copyright (c) 2004-2010 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
SHIPPED = [
    (MIT_FULL, "MIT"), (BSD_HEAD + BSD + BSD_END, "BSD-2-Clause"), (BSD_HEAD + BSD + "\n" + BSD3 + BSD_END, "BSD-3-Clause"), (APACHE_FULL, "Apache-2.0"),
    (GPL_FULL, "GPL-3.0-or-later"), (GPL_FULL.replace("version 3", "version 2"), "GPL-2.0-or-later"), (MPL_FULL, "MPL-2.0"), (ISC, "ISC"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("Copyright 2020 The Some Authors. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"),
]


def test_texts_as_shipped(spark):
    marks = ["", "# ", "// ", " * ", "rem "]
    r = scan(spark, *["int a = 1;\n" + "\n".join(m + line for line in t.split("\n")) + "\nint b = 2;" for m in marks for t, _ in SHIPPED])
    want = [[x] for _ in marks for _, x in SHIPPED]
    assert [r[i].licenses for i in range(len(want))] == want
    assert not any(r[i].restricted or r[i].n_unmatched for i in range(len(want)))


def test_copyright_lines(spark):
    r = scan(
        spark, "Copyright law is complex. All rights reserved.", "Copyright law is complex.", "Copyright (c) Some Body. All rights reserved.",
        "Copyright 2020 A\nCopyright 2021 B\nAll rights reserved.", "Copyright (c) 2020 A. All rights reserved.\nReleased under the MIT License.",
    )
    assert [r[i].sentence_ids for i in (0, 1)] == [["all-rights"], []]
    assert [r[i].licenses for i in (2, 3, 4)] == [["Proprietary"], ["Proprietary"], ["MIT"]] and r[3].n_unmatched == 0


def test_repeated_rows_and_very_long_texts(spark):
    long = "word. " * 300_000 + "\n" + MIT_FULL + "rem " * 200_000 + "\n" + "copyright " * 100_000 + "the name of " * 100_000
    df = spark.createDataFrame([(1, long), (1, long), (2, MIT_FULL), (2, MIT_FULL), (None, ISC)], "doc_id long, text string")
    assert sorted((r.id or 0, r.licenses[0]) for r in license_scan(df).collect()) == [(0, "ISC"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (2, "MIT")]


def test_shipped_texts_equal_the_sql(spark, tmp_path):
    import duckdb

    from civicpulse.llm.license_scan import OP2_SQL, op2_license_scan

    texts = [t for t, _ in SHIPPED] + ["x\n" + t + "y" for t, _ in SHIPPED] + ["Copyright law is complex. All rights reserved.", None, "", APACHE, BSD, "of cc by 4.0"]
    texts += [". ".join(SENTENCES[n][-1] for n in names) for names, _ in RULES]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(OP2_SQL)
    got = op2_license_scan(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
