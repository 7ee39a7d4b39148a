"""A transport for the data source: 250 comments in pages, and a video without any."""


def fetch(video_id, size, token):
    start = int(token or 0)
    total = 0 if video_id == "none" else 250
    items = [{"author": None if i == 0 else f"a{i}", "text": f"t{i}", "likes": i, "published_at": "2026-01-05T10:00:00Z" if i % 2 else "bad"} for i in range(start, min(total, start + size))]
    return {"items": items, "next": str(start + size) if start + size < total else None}
