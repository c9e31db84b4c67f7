"""A pull parser: JSON texts of any size and depth, read from parts, one value at a time.

Used inside tasks where a text does not fit a row or nests deeper than a recursive parser can follow. All state is the
stack of open objects and arrays and the unread end of one part.
"""

from __future__ import annotations


def puller():
    """``(events, items)`` as closures, so that they travel to executors that lack this package.

    ``events(parts)`` yields ``(kind, value)``: ``{ } [ ]``, ``key`` and ``value``. It raises ``ValueError`` on what is not
    JSON. ``items(parts, wanted)`` yields ``(path, value)`` of the values at a path for which ``wanted`` holds, each built
    in memory by itself; elements of arrays have ``*`` in their path.
    """
    import json
    import re

    token = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![^\s,:\[\]{}"]))')
    blank = re.compile(r"[ \t\n\r]*")

    def tokens(parts):
        text, at, ended, source = "", 0, False, iter(parts)
        while True:
            found = token.match(text, at)
            # a number or word at the end may go on in the next part
            if found is None or (found[3] and found.end() == len(text) and not ended):
                if ended:
                    if blank.match(text, at).end() == len(text):
                        return
                    raise ValueError("not JSON")
                # an unfinished token is kept; a string that spans many parts is put together once
                held = [text[at:]]
                size = len(held[0])
                while True:
                    part = next(source, None)
                    if part is None:
                        ended = True
                        break
                    held.append(part)
                    size += len(part)
                    if size >= 2 * len(held[0]):
                        break
                text, at = "".join(held), 0
                continue
            at = found.end()
            yield found

    def plain(found):
        if found[2]:
            raw = found[2]
            return json.loads(raw) if "\\" in raw else raw[1:-1]
        return json.loads(found[3])

    def events(parts):
        stack, expect = [], "value"  # value, first (value or ]), key, firstkey (key or }), colon, next
        for found in tokens(parts):
            mark = found[1]
            if expect == "done":
                raise ValueError("more than one value")
            if mark is None:
                if expect in ("key", "firstkey") and found[2]:
                    yield "key", plain(found)
                    expect = "colon"
                    continue
                if expect not in ("value", "first"):
                    raise ValueError("not JSON")
                yield "value", plain(found)
            elif mark in "{[":
                if expect not in ("value", "first"):
                    raise ValueError("not JSON")
                stack.append(mark)
                yield mark, None
                expect = "firstkey" if mark == "{" else "first"
                continue
            elif mark in "}]":
                if not stack or stack[-1] != ("{" if mark == "}" else "[") or expect not in ("next", "firstkey" if mark == "}" else "first"):
                    raise ValueError("not JSON")
                stack.pop()
                yield mark, None
            elif mark == ":":
                if expect != "colon":
                    raise ValueError("not JSON")
                expect = "value"
                continue
            else:
                if expect != "next" or not stack:
                    raise ValueError("not JSON")
                expect = "key" if stack[-1] == "{" else "value"
                continue
            expect = "next" if stack else "done"
        if expect != "done":
            raise ValueError("text ends early")

    def items(parts, wanted):
        path, built = [], []  # built: the containers of the value being put together, outermost first
        taking = None

        def put(value):
            holder, key = built[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)

        for kind, value in events(parts):
            if kind == "key":
                path[-1] = value
                if built:
                    built[-1][1] = value
                continue
            if kind in "{[":
                fresh = {} if kind == "{" else []
                if built:
                    put(fresh)
                    built.append([fresh, None])
                elif wanted(tuple(path)):
                    taking = tuple(path)
                    built.append([fresh, None])
                path.append(None if kind == "{" else "*")
                continue
            if kind in "}]":
                path.pop()
                if built:
                    done = built.pop()[0]
                    if not built:
                        yield taking, done
                continue
            if built:
                put(value)
            elif wanted(tuple(path)):
                yield tuple(path), value

    return events, items
