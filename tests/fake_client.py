"""A service for the tests: every query has totals and pages that follow from its text and year."""

import zlib


def total_of(request: dict) -> int:
    return 3 + zlib.crc32(f"{request['query']}{request['year']}".encode()) % 9


def paged(request: dict, size: int = 2) -> tuple[int, range, str | None]:
    total, at = total_of(request), int(request["token"] or 0)
    if request["most"]:
        total = min(total, request["most"] + 1)  # a server's sample may be a little larger
    ids = range(at, min(at + size, total))
    return total_of(request), ids, str(at + size) if at + size < total else None


def s2(request: dict) -> dict:
    total, ids, token = paged(request)
    title = {"GAN": "GaN chip", "SIC": "SiC and GaN chip", "domain": "a chip of GaN"}[request["key"]]
    return {"total": total, "token": token, "records": [{"paperId": f"{request['year']}-{i}", "title": title, "abstract": "text", "year": None if i == 0 else request["year"], "citationCount": i, "venue": "IEEE X" if i % 2 else None} for i in ids]}


def openalex(request: dict) -> dict:
    total, ids, token = paged(request)
    return {"total": total, "token": token, "records": [{"id": f"W{request['year']}{request['key']}{i}s{request['seed']}", "title": "GaN chip", "publication_year": request["year"], "abstract_inverted_index": {"text": [0]}} for i in ids]}


def arxiv(request: dict) -> dict:
    total, ids, token = paged(request)
    return {"total": total, "token": token, "records": [{"id": f"http://arxiv.org/abs/{request['year']}.{i}v1", "title": "GaN chip", "summary": "text", "published": f"{request['year']}-01-01T00"} for i in ids]}


def failing(request: dict) -> dict:
    if request["year"] == 2021 and request["key"] == "SIC":
        raise RuntimeError("the service is gone")
    return s2(request)
