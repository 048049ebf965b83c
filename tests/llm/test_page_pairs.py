"""Differencing on whole pages, against a plain pairing and alignment."""

import html as entities
import random

from cellweave.llm import html


def page(k, lines, notice="Read more with a free account", main=True):
    body = "".join(f"<p>{entities.escape(x)}</p>" for x in lines)
    inner = f"<div class='x1'>{notice}</div>{body}<div class='x2'>{notice} today</div>"
    return f"<html><body><nav>menu {k}</nav>{f'<article>{inner}</article>' if main else f'<div>{inner}</div>'}<footer>f {k}</footer></body></html>"


def longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = 1 + n[i + 1][j + 1] if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain(rows):
    """Texts by page_id: pairs of neighbours in order of host and path, shared lines by dynamic programming."""
    order = sorted(rows, key=lambda r: (html.place_of(r[1]), r[0]))
    all_blocks = {r[0]: html.parsed(r[2]) for r in rows}
    found, lines, gone_of, pairs = {}, {}, {}, {}
    for k, (pid, url, _) in enumerate(order):
        host, path = html.place_of(url)
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(order) and html.place_of(order[j][1])[0] == host]
        own = all_blocks[pid]
        zone = "main" if any(z == "main" for z, _, _ in own) else "open"
        keep = [i for i, b in enumerate(own) if b[0] == zone]
        found[pid] = (zone, keep, host)
        if not near or not keep:
            continue
        j = max(near, key=lambda j: (html.shared_prefix(html.place_of(order[j][1])[1], path), -j))
        texts = lambda p: [t for _, t, _ in all_blocks[p]]
        gone = set(longest(texts(pid), texts(order[j][0]))) & set(keep)
        if zone == "main" and 2 * len(gone) > len(keep):
            continue
        gone_of[pid] = gone
        if zone == "main":
            for t in {own[i][2] for i in keep}:
                pairs[host, t] = pairs.get((host, t), 0) + 1
            for i in keep:
                n, s = lines.get((host, own[i][2]), (0, 0))
                lines[host, own[i][2]] = (n + 1, s + (i in gone))
    bad = {t for t, (n, s) in lines.items() if s >= 0.8 * n and pairs[t] >= 3}
    out = {}
    for pid, (zone, keep, host) in found.items():
        gone = gone_of.get(pid, set())
        out[pid] = " ".join(all_blocks[pid][i][1] for i in keep if i not in gone or zone == "main" and (host, all_blocks[pid][i][2]) not in bad)
    return out


def test_pairs_equal_plain(spark):
    rng = random.Random(3)
    line = lambda: " ".join("w%d" % rng.randrange(900) for _ in range(8))
    passage, rows = [line() for _ in range(2)], []
    for k in range(120):
        host = ("a.com", "b.org", "c.net")[k % 3]
        lines = [line() for _ in range(rng.randrange(3, 9))]
        if k % 4 == 0:
            lines[1:1] = passage
        rows.append((k, f"http://{host}/{'abc'[k % 7 % 3]}/{rng.randrange(10**6)}", page(k, lines, main=k % 3 < 2)))
    rows += [(200 + k, f"http://d.com/{k}", page(k, ["one article that is copied whole", "in several places of a host", f"with its own last line {k}"])) for k in range(8)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain(rows)
    deleted = [k for k in range(120) if k % 3 < 2 and "free account" not in got[k]]
    assert len(deleted) >= 76 and all(passage[0] in got[k] for k in deleted if k % 4 == 0)
    assert all("copied whole" in got[200 + k] for k in range(8))


def test_names_of_classes():
    assert not html.marked("side-by-side") and not html.marked("related-work") and not html.marked("lead")
    assert html.marked("cookie-notice") and html.marked("ad") and html.marked("reader-comments") and html.marked("relatedPosts")
    text = "<article><p>a</p><div class='side-by-side'>b</div><div class='related-work'>c</div><div class='ad'>d</div></article>"
    assert [t for z, t in html.blocks(text) if z == "main"] == ["a", "b", "c"]


def test_a_very_long_page(spark):
    rows = [(k, f"http://h.com/{k}", "<article>" + "".join(f"<p>line {k} {i} {'x' * 40}</p>" for i in range(20_000)) + "</article>") for k in range(2)]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(" ".join(f"line {k} {i} {'x' * 40}" for i in range(20_000))) for k in range(2))
