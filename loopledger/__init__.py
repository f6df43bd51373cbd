"""loopledger: find and price calls that cost money inside loops, over code corpora of any size."""

from .operators.dedup import scan_distinct
from .operators.pricing import price_with, price_with_counts
from .operators.scan import findings_of, scan
from .rules import BUILTIN_RULES, CallPattern, LinePattern, Rule
from .sources.snippets import embedded_scripts, parse_requests, snippets
from .sources.tree import list_tree, read_path, read_tree

__all__ = [
    "BUILTIN_RULES", "CallPattern", "LinePattern", "Rule", "embedded_scripts", "findings_of", "list_tree",
    "parse_requests", "price_with", "price_with_counts", "read_path", "read_tree", 
    "scan", "scan_distinct", "snippets",
]
