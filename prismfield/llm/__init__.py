"""Training-data operators: one module per operator, `queries` registers them.

Nothing outside this subpackage imports it; the host entry module adds its queries only
when it can be imported.
"""
