"""Clinical text analytics on Spark: notes in, entities, medications, PHI reports and review tables out."""
