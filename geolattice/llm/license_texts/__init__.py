"""Whole license texts, one file a license, and the headers that licenses ask source files to carry."""

from __future__ import annotations

from importlib.resources import files

_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."

#: The identifying paragraph of headers and of short texts, by license.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", _GNU.format(what="program", kind="General Public License", version="2", colon=";", comma=";")),
    ("GPL-3.0", _GNU.format(what="program", kind="General Public License", version="3", colon=":", comma=",")),
    ("LGPL-2.1", _GNU.format(what="library", kind="Lesser General Public License", version="2.1", colon=";", comma=";")),
    ("LGPL-3.0", _GNU.format(what="program", kind="Lesser General Public License", version="3", colon=":", comma=",")),
    ("AGPL-3.0", _GNU.format(what="program", kind="Affero General Public License", version="3", colon=":", comma=",")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
)


def long_templates() -> tuple[tuple[str, str], ...]:
    """(license, text) of all headers and whole texts. Read on the driver only."""
    found = sorted((f for f in files(__name__).iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return (*HEADERS, *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in found))
