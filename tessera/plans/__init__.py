"""Multi-step plans and the search engine facade."""
