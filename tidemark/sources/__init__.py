"""Where rows come from and go to: keyed tables, JSON and Arrow edges, polled and pushed streams."""
