"""Retrieved windows as a prompt, as JSON and as lines to read; on the few rows of a collected answer."""

from __future__ import annotations

#: Marks of cut texts.
CUT, CUT_WINDOW = "...[truncated]", "\n...[window truncated]"
FIELDS = ["ts_start", "ts_end", "source", "principal", "src_ip", "n_events", "n_failures", "risk_score", "event_names", "event_ids"]


def prompt(hits: list[dict], most_chars: int = 0, separator: str = "\n\n") -> str:
    """The texts of the windows, each with its header; with ``most_chars`` each cut to that."""
    cut = lambda t: t[:most_chars].rstrip() + CUT_WINDOW if most_chars and len(t) > most_chars else t
    return separator.join(cut(h["text"]) for h in hits)


def found_by(hit: dict) -> list[str]:
    return sorted(name for name in ("bm25", "dense") if hit.get(f"{name}_rank") is not None)


def as_dict(hit: dict, text_chars: int = 0) -> dict:
    text, again = hit.get("text", ""), hit.get("rerank_score")
    return {"chunk_id": hit["chunk_id"], "rank": hit["rank"], "score": round(again if again else hit["score"], 6), "fusion_score": round(hit["score"], 6),
            "rerank_score": None if again is None else round(again, 6), "dense_rank": hit.get("dense_rank"), "bm25_rank": hit.get("bm25_rank"), "found_by": found_by(hit),
            **{k: hit.get(k) for k in FIELDS}, "text": text[:text_chars] + CUT if text_chars and len(text) > text_chars else text}


def answer(question: str, hits: list[dict], diagnostics: dict | None = None, text_chars: int = 600) -> dict:
    return {"question": question, "hits": [as_dict(h, text_chars) for h in hits], "diagnostics": diagnostics or {}}


def ranked_lines(title: str, rows: list[dict], name: str, width: int = 46) -> list[str]:
    """A list of names with their counts; long names are cut."""
    short = lambda t: t if len(t) <= width else t[:width - 1] + "…"
    return [title, *(f"  {i:>2}. {short(str(r[name])):<{width}} {r['n']:>8,}  failures {r['failures']:,}" for i, r in enumerate(rows, 1))]


def hit_lines(hit: dict, events: int = 0) -> list[str]:
    """A hit with where it was found (``dense#2 bm25#1``), its facts, and its first ``events`` events."""
    where = " ".join(f"{name}#{hit[f'{name}_rank']}" for name in ("dense", "bm25") if hit.get(f"{name}_rank") is not None)
    facts = f"{hit['chunk_id']}  {hit['ts_start']} -> {hit['ts_end']}  {hit['source']}  {hit['principal'] or '-'}  {hit['src_ip'] or '-'}"
    lines = [f"{hit['rank']:>2}. {facts}", f"    score {hit['score']:.6f}  [{where}]  events {hit['n_events']}  failures {hit['n_failures']}  risk {hit['risk_score']}"]
    return lines + [f"      {line}" for line in (hit.get("events") or [])[:events]]
