"""Notices that are wrapped over lines, as they mostly stand in files."""

from tracewell.llm import licences as lic

GPL = """\
/* tool.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Some prose stands here.
 */"""
BSD = """\
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:

x = 1"""
MIT = """\
Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction\r
"""


def test_wrapped_notices_are_named(spark):
    rows = [(1, GPL), (2, BSD), (3, MIT), (4, MIT + "\n\n" + BSD), (5, "Released under the MIT License.\n" + BSD), (6, "One line.\nAnother one.\n\nA third.")]
    got = {r.doc_id: [(n.line, n.family, n.confirmed) for n in r.notices] for r in lic.with_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [(2, "gpl", True)]
    assert got[2] == [(0, "bsd", True)]
    assert got[3] == [(0, "mit", True)]
    assert got[4] == [(0, "mit", True), (5, "bsd", True)]
    assert (0, "mit", True) in got[5]
    assert got[6] == []
