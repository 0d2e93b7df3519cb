"""Training-data operators: each module one operator with its own interface; `queries` names their contract queries."""
