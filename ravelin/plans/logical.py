"""A logical plan as text, one node a line."""

from __future__ import annotations

from ravelin.plans.tree import Options, Request, sequence_text


def lines(options: Options, source: list[str], depth: int = 0) -> list[str]:
    """From the last operation down to the scan."""
    steps = list(source)
    if options.at or options.from_:
        steps.append(f"AtTime({options.at or options.from_})")
    if options.search is not None:
        steps.append(f"Search({options.search})")
    for step in options.apply:
        steps.append(f"Apply({sequence_text((step,))})")
    if options.compute:
        steps.append(f"Compute({','.join(map(str, options.compute))})")
    if options.filter is not None:
        steps.append(f"Select({options.filter})")
    if options.orderby:
        steps.append(f"Sort({','.join(map(str, options.orderby))})")
    if options.skiptoken is not None:
        steps.append(f"After({options.skiptoken})")
    if options.skip or options.top is not None:
        steps.append(f"Slice(skip={options.skip or 0}, top={options.top})")
    for e in options.expand:
        steps.append(f"Nest({e.path})" + (f"[{'; '.join(lines(e.options, ['Members'])[::-1])}]" if e.options != Options() else ""))
    if options.select:
        steps.append(f"Project({','.join(options.select)})")
    return ["  " * (depth + i) + s for i, s in enumerate(reversed(steps))]


def explain(request: Request) -> str:
    source = []
    for i, s in enumerate(request.segments):
        keys = f"({','.join(f'{k}={v}' if k else str(v) for k, v in s.keys)})" if s.keys is not None else ""
        source.append(f"Scan({s.name})" if not i else f"Select({s.filter})" if s.name == "$filter" else f"Follow({s.name})")
        if keys:
            source.append(f"Key{keys}")
    return "\n".join(lines(request.options, source))
