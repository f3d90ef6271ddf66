"""Operators over nodes, edges, claims and logs; each is a pure DataFrame-to-DataFrame function."""
