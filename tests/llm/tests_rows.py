def rows_of(columns, rows):
    """Rows with columns in the order of their names and values as text, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if x is None or isinstance(x, bool):
            return str(x)
        return f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)
