"""Lending-market analytics on Spark; see README.md. Start from poolscope.plans.pipelines."""
