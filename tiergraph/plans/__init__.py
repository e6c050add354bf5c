"""Plans that assemble operators: graph assembly, dossiers, research protocols."""
