"""One self-contained page of a view: boxes, links between them and, if wanted, source, packed into the page itself."""

from __future__ import annotations

import base64
import gzip
import html
import json

#: Rows that the search box of a page lists.
FOUND = 500

_SCRIPT = """
const unpack = async id => JSON.parse(await new Response(new Blob([Uint8Array.from(atob(document.getElementById(id).textContent), c => c.charCodeAt(0))]).stream().pipeThrough(new DecompressionStream('gzip'))).text());
const view = await unpack('view');
const canvas = document.querySelector('canvas'), draw = canvas.getContext('2d');
let zoom = 1, left = 0, top_ = 0, lit = new Set(view.highlight);
const at = new Map(view.boxes.map(b => [b.id, b]));
function paint() {
  canvas.width = innerWidth; canvas.height = innerHeight;
  const s = zoom * Math.min(innerWidth / view.width, innerHeight / view.height), X = v => left + v * s, Y = v => top_ + v * s;
  for (const b of view.boxes) {
    draw.fillStyle = lit.has(b.id) ? '#f6c445' : `hsl(210 20% ${96 - 5 * b.depth}%)`; draw.strokeStyle = '#8899aa';
    draw.fillRect(X(b.x), Y(b.y), b.w * s, b.h * s); draw.strokeRect(X(b.x), Y(b.y), b.w * s, b.h * s);
    if (b.w * s > 40 && b.h * s > 12) { draw.fillStyle = '#223'; draw.fillText(b.name, X(b.x) + 3, Y(b.y) + 10); }
  }
  for (const e of view.links) {
    const a = at.get(e.a), b = at.get(e.b); if (!a || !b) continue;
    draw.strokeStyle = ['#cc9999', '#99aacc', '#447744'][e.rank] || '#999'; draw.beginPath();
    draw.moveTo(X(a.x + a.w / 2), Y(a.y + a.h / 2)); draw.lineTo(X(b.x + b.w / 2), Y(b.y + b.h / 2)); draw.stroke();
  }
}
addEventListener('resize', paint);
canvas.addEventListener('wheel', e => { const f = e.deltaY < 0 ? 1.2 : 1 / 1.2; left = e.clientX - (e.clientX - left) * f; top_ = e.clientY - (e.clientY - top_) * f; zoom *= f; paint(); e.preventDefault(); });
canvas.addEventListener('pointermove', e => { if (e.buttons) { left += e.movementX; top_ += e.movementY; paint(); } });
document.querySelector('input').addEventListener('input', e => {
  const wanted = e.target.value.toLowerCase();
  const found = wanted ? view.boxes.filter(b => b.id.toLowerCase().includes(wanted)).slice(0, FOUND) : [];
  lit = new Set(wanted ? found.map(b => b.id) : view.highlight); paint();
  document.querySelector('ol').replaceChildren(...found.map(b => { const i = document.createElement('li'); i.textContent = b.id; return i; }));
});
paint();
"""


def packed(value: object) -> str:
    """JSON, compressed, as text that can stand in a page; the same for the same value."""
    return base64.b64encode(gzip.compress(json.dumps(value, sort_keys=True, separators=(",", ":")).encode(), mtime=0)).decode()


def unpacked(text: str) -> object:
    return json.loads(gzip.decompress(base64.b64decode(text)))


def render_html(title: str, view: dict, source: dict[str, str] | None = None) -> str:
    """A page that needs nothing but itself. ``view`` has ``boxes``, ``links``, ``highlight``, ``summary``, ``width``, ``height``; ``source`` is a payload of its own."""
    numbers = " · ".join(f"{k}: {v}" for k, v in view.get("summary", {}).items())
    blobs = f'<script type="text/plain" id="view">{packed(view)}</script>'
    if source:
        blobs += f'<script type="text/plain" id="source">{packed(source)}</script>'
    style = "body{margin:0;font:12px sans-serif}canvas{display:block}header{position:fixed;background:#fffd;padding:4px 8px}ol{max-height:40vh;overflow:auto;margin:0}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><header><b>{html.escape(title)}</b> {html.escape(numbers)}<br><input placeholder="find"><ol></ol></header><canvas></canvas>{blobs}<script type="module">{_SCRIPT.replace("FOUND", str(FOUND))}</script></body></html>'
