"""Driver-side model of duplicate merging, for tests only: plain loops over one report."""

from difflib import SequenceMatcher

RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def file_of(f):
    return None if f["file"] is None else f["file"].strip().lower()


def same_file(a, b):
    return file_of(a) is not None and file_of(a) == file_of(b)


def overlap(a, b):
    if a["line_start"] is None or b["line_start"] is None:
        return False
    a_end, b_end = a["line_end"] or a["line_start"], b["line_end"] or b["line_start"]
    return a_end >= b["line_start"] and b_end >= a["line_start"]


def duplicates(a, b):
    if a["category"].lower() != b["category"].lower():
        return False
    r = ratio(a["title"], b["title"])
    return r >= 0.85 or (same_file(a, b) and (r >= 0.65 or overlap(a, b)))


def merge(group):
    if len(group) == 1:
        return {**group[0], "merged_from": []}
    best = group[0]
    for f in group[1:]:
        if (RANK[f["severity"]], f["confidence"]) > (RANK[best["severity"]], best["confidence"]):
            best = f
    static = any(f["source"] == "static_analysis" for f in group)
    kept = [best["description"]]
    for f in group:
        if f is not best and ratio(f["description"], kept[-1]) < 0.65:
            kept.append(f["description"])
    advice = ""
    for f in group:
        if len(f["recommendation"]) > len(advice):
            advice = f["recommendation"]

    def first(name):
        return next((f[name] for f in group if f[name]), None)

    return {
        **best,
        "agent": " + ".join(dict.fromkeys(f["agent"] for f in group)),
        "confidence": min(best["confidence"] + 10 * (len(group) - 1) + 15 * static, 100),
        "source": "static_analysis" if static else best["source"],
        "description": " | ".join(kept[:3]),
        "recommendation": advice or best["recommendation"],
        "code_snippet": first("code_snippet"),
        "suggested_fix": first("suggested_fix"),
        "merged_from": [f["id"] for f in group],
    }


def deduplicate(findings):
    """Merged findings of one report, in reporting order; ids are not renewed."""
    static = [f for f in findings if f["source"] == "static_analysis"]
    other = []
    for f in findings:
        if f["source"] != "static_analysis":
            hit = any(same_file(f, s) and ratio(f["title"], s["title"]) >= 0.65 for s in static)
            other.append({**f, "confidence": min(f["confidence"] + 15, 100)} if hit else f)
    groups = []
    for f in other + static:
        home = next((g for g in groups if duplicates(g[0], f)), None)
        if home is None:
            groups.append([f])
        else:
            home.append(f)
    merged = [merge(g) for g in groups]
    return sorted(merged, key=lambda f: (-RANK[f["severity"]], -f["confidence"]))
